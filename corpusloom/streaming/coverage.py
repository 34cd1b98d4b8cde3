"""Rounds of a stream until enough has been covered."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Coverage(StreamingQueryListener):
    """Adds up the rows of a query's batches as they are reported."""

    def __init__(self):
        self.rows, self.batches = 0, []

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows and (str(p.runId), p.batchId) not in self.batches:
            self.batches.append((str(p.runId), p.batchId))
            self.rows += p.numInputRows

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def until_covered(spark: SparkSession, start: Callable[[], StreamingQuery], target: int, covered: Callable[[], int] | None = None, pause_s: float = 30.0, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Start rounds (queries that take what is there and end) until
    ``covered()`` reaches ``target``, with a pause between rounds that fall
    short; by default the rows that the rounds have read count. Returns what is
    covered. ``rounds`` bounds the waiting; a failed round raises."""
    seen = Coverage()
    spark.streams.addListener(seen)
    try:
        have = covered() if covered else 0
        done = 0
        while have < target and (rounds is None or done < rounds):
            if done:
                sleep(pause_s)
            query = start()
            query.awaitTermination()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            query.lastProgress  # noqa: B018  the listener's reports are in once the last one is
            have = covered() if covered else seen.rows
            done += 1
        return have
    finally:
        spark.streams.removeListener(seen)
