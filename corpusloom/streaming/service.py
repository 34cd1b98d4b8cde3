"""Search as a stream, and exactly-once collection of new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import search


def serve(queries: DataFrame, entries: DataFrame, path: str, checkpoint: str, answer: Callable[[DataFrame, DataFrame], DataFrame] = search, **trigger) -> StreamingQuery:
    """Answer a stream of queries against a static table. Each micro-batch is
    one batch search, written to its own folder of ``path``: a batch that is
    run again after a failure replaces its own answers."""

    def batch(rows: DataFrame, number: int) -> None:
        answer(rows, entries).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def collect_new(rows: DataFrame, key: str, path: str, checkpoint: str, event_time: str | None = None, delay: str = "1 hour", **trigger) -> StreamingQuery:
    """Append the first row of every key. With ``event_time`` the state of a
    key goes once the watermark is ``delay`` past it; without, keys are kept
    for good."""
    if event_time:
        rows = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    else:
        rows = rows.dropDuplicates([key])
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
