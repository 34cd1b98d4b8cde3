"""Line, JSON-lines and CSV tables, resumable sinks and versioned updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..plans.session import sized

BOM = "\ufeff"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines with a given schema (no inference scan); a line that
    isn't JSON keeps its text in ``_corrupt_record`` when the schema has it."""
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str, name: str = "query") -> DataFrame:
    """Trimmed lines that have text, without a byte-order mark."""
    line = F.trim(F.ltrim(F.col("value"), F.lit(BOM)))
    return spark.read.text(path).select(line.alias(name)).where(F.col(name) != "")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file, line (from 1) and n (from 0, over all files in the order of
    their paths) of every line.

    Rows of a split have consecutive ids in file order, so a line's number is
    its distance from its split's first id and the lines of the splits before.
    Only one row for each split is grouped and sorted, and written as a table
    whose size Spark knows, so it is sent to the lines while it is small."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("file", "block").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("file").agg(F.sum("size").alias("size"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    base = files.select("file", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("above"))
    known = sized(splits.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, "file").drop("size"))
    line = F.col("before") + F.col("at") - F.col("first")
    return raw.join(known, ["file", "block"]).select("value", "file", (line + 1).alias("line"), (F.col("above") + line).alias("n"))


BAD = "_bad"


def _parsed(value, schema: StructType | str):
    """A JSON object by ``schema`` with the text of a line that isn't one in ``BAD``."""
    whole = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return F.from_json(value, StructType([*whole.fields, StructField(BAD, StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})


def _filled(value):
    return F.trim(F.regexp_replace(F.ltrim(value, F.lit(BOM)), "(?U)\\s+", " ")) != ""


def read_jsonl_strict(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; the first line met that isn't an object of the
    schema stops the query with ``file:line``. Blank lines are skipped."""
    rows = numbered_lines(spark, path).where(_filled(F.col("value"))).withColumn("j", _parsed(F.ltrim(F.col("value"), F.lit(BOM)), schema))
    wrong = F.raise_error(F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": not a JSON object of the schema")))
    # the check stands in every column, so no projection can lose it
    return rows.select(F.when(F.col("j").isNull() | F.col(f"j.{BAD}").isNotNull(), wrong).otherwise(F.col("j")).alias("j")).select("j.*").drop(BAD)


def read_jsonl_lenient(spark: SparkSession, path: str | list[str], schema: StructType | str) -> tuple[DataFrame, Observation]:
    """The good rows, and counts of lines, blank and malformed ones that are
    there once the rows have been read."""
    seen = Observation("jsonl")
    rows = spark.read.text(path).withColumn("full", _filled(F.col("value"))).withColumn("j", _parsed(F.ltrim(F.col("value"), F.lit(BOM)), schema))
    bad = F.col("full") & (F.col("j").isNull() | F.col(f"j.{BAD}").isNotNull())
    counted = rows.withColumn("bad", bad).observe(seen, F.count("*").alias("lines"), F.count_if(~F.col("full")).alias("blank"), F.count_if("bad").alias("malformed"))
    return counted.where(F.col("full") & ~F.col("bad")).select("j.*").drop(BAD), seen


def head_lines(spark: SparkSession, path: str | list[str], n: int) -> DataFrame:
    """The first ``n`` lines that have text, in the order of files and lines."""
    full = numbered_lines(spark, path).where(_filled(F.col("value")))
    return full.orderBy("n").limit(n)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns as trimmed strings: absent ones, nulls and ``nan`` are
    empty, a byte-order mark on the header is dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip(BOM) for c in raw.columns])

    def cell(name):
        if name not in raw.columns:
            return F.lit("").alias(name)
        text = F.trim(F.coalesce(F.col(f"`{name}`").cast(StringType()), F.lit("")))
        return F.when(F.lower(text) == "nan", "").otherwise(text).alias(name)

    return raw.select(*[cell(c) for c in columns])


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table at ``path`` lacks; a second run
    after a failure adds nothing twice."""
    spark = df.sparkSession
    if exists(spark, path):
        known = spark.read.parquet(path).select(key).distinct()
        df = df.join(known, key, "left_anti")
    df.dropDuplicates([key]).write.mode("append").parquet(path)


def exists(spark: SparkSession, *paths: str) -> bool:
    """Whether all of these are there, on any file system Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    return all(p.getFileSystem(conf).exists(p) for p in (jvm.org.apache.hadoop.fs.Path(p) for p in paths))


def stale(spark: SparkSession, source: str, derived: str, file_format: str = "parquet") -> bool:
    """Whether ``derived`` is missing or older than the newest source file."""
    if not exists(spark, derived):
        return True
    newest = lambda p, f: spark.read.format(f).load(p).select(F.max("_metadata.file_modification_time")).first()[0]
    made, came = newest(derived, "parquet"), newest(source, file_format)
    return made is None or (came is not None and came > made)
