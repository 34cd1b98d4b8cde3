"""Event-time windows, the same functions over tables and streams.

Rows without a time or a key have no window. On a stream a row whose window has
closed (the watermark is past its end) is dropped; a table has no late rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import _col


def _timed(rows: DataFrame, time: str, keys: list[str], delay: str | None) -> DataFrame:
    rows = rows.where(" and ".join(f"`{c}` is not null" for c in [time, *keys]))
    return rows.withWatermark(time, delay) if rows.isStreaming and delay else rows


def sessions(rows: DataFrame, time: str, keys: list[str], gap: str, value: str, delay: str | None = None) -> DataFrame:
    """Runs of a key's rows, each within ``gap`` of the one before: keys,
    session_start, session_end (last row and ``gap``), n, total."""
    grouped = _timed(rows, time, keys, delay).groupBy(*keys, F.session_window(time, gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum(_col(value)), 4).alias("total")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def windows(rows: DataFrame, time: str, keys: list[str], size: str, slide: str | None, value: str, delay: str | None = None) -> DataFrame:
    """Tumbling windows, or with ``slide`` overlapping ones: keys, window_start,
    n, total, distinct-free and so mergeable in any order."""
    grouped = _timed(rows, time, keys, delay).groupBy(*keys, F.window(time, size, slide or size).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum(_col(value)), 4).alias("total")).select(*keys, F.col("w.start").alias("window_start"), "n", "total")


def start(result: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append every window once, when it has closed."""
    return result.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
