"""Quality figures of tagged sentences, gathered while the rows are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import tokens as K


def checks(rows: DataFrame) -> DataFrame:
    """length_ok, bmes_ok and pos_ok of each row (text, seg_tags,
    pos_tags). pos_ok is null where the arrays' lengths differ or one is empty;
    a null or empty array has no tags, so length_ok and bmes_ok are false."""
    tagged = F.coalesce(F.size("seg_tags"), F.lit(0)) > 0
    fits = F.size("seg_tags") == F.length(F.replace("text", F.lit(" "), F.lit("")))
    word = lambda w: F.size(F.array_distinct(F.slice("pos_tags", w["begin"] + 1, w["end"] - w["begin"]))) == 1
    same = F.when(tagged & (F.size("pos_tags") == F.size("seg_tags")), F.forall(K.word_ends("seg_tags"), word))
    return rows.withColumn("length_ok", F.coalesce(tagged & fits, F.lit(False))).withColumn("bmes_ok", F.coalesce(tagged & K.bmes_valid("seg_tags", strict=True), F.lit(False))).withColumn("pos_ok", same)


def observed(rows: DataFrame, name: str = "quality") -> tuple[DataFrame, Observation]:
    """The checked rows, and their figures once an action has passed over them:
    n, has_seg, has_pos, length_ok, bmes_ok, pos_consistent, pos_inconsistent."""
    seen = Observation(name)
    has = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0)
    figures = [F.count("*").alias("n"), has("seg_tags").alias("has_seg"), has("pos_tags").alias("has_pos"), F.count_if("length_ok").alias("length_ok"), F.count_if("bmes_ok").alias("bmes_ok"), F.count_if("pos_ok").alias("pos_consistent"), F.count_if(~F.col("pos_ok")).alias("pos_inconsistent")]
    return checks(rows).observe(seen, *figures), seen
