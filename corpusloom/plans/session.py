"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session that names none
    (tests) gets a temporary one; on a cluster the setting is needed, as
    executors share no folder of the driver's machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in ``folder``."""
    folder(df.sparkSession)
    return df.checkpoint()


def sized(df: DataFrame) -> DataFrame:
    """``df`` as a table in ``folder``: a later join knows its size, and sends
    it to the other side only while it is small."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
