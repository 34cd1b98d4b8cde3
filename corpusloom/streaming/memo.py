"""Answers remembered in keyed state, the least recently used one forgotten.

Texts are dealt to ``shards`` by hash, so equal texts meet in one state; each
shard remembers ``capacity`` results and ``compute`` is called only for a text
that its shard doesn't know. The state of a shard has at most ``capacity``
results and their last uses. Null texts are computed and remembered like any
other text, under a key of their own. Results must be strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Memo(StatefulProcessor):
    def __init__(self, compute: Callable[[str | None], str | None], capacity: int):
        self.compute, self.capacity = compute, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = StructType([StructField("text", StringType())])
        self.kept = handle.getMapState("kept", text, StructType([StructField("result", StringType()), StructField("used", LongType())]))
        self.clock = handle.getValueState("clock", StructType([StructField("t", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        t = self.clock.get()[0] if self.clock.exists() else 0
        # the shard's memory, at most ``capacity`` results, in order of last use
        held = {k[0]: (v[0], v[1]) for k, v in self.kept.iterator()} if self.kept.exists() else {}
        order = dict.fromkeys(sorted(held, key=lambda x: held[x][1]))
        before = dict(held)
        for frame in rows:
            out = []
            for row_id, text in zip(frame["row_id"], frame["text"]):
                name, t = "-" if text is None else "+" + text, t + 1
                known = name in held
                if known:
                    order.pop(name)
                elif len(held) == self.capacity:
                    oldest = next(iter(order))
                    order.pop(oldest)
                    held.pop(oldest)
                held[name] = (held[name][0] if known else self.compute(text), t)
                order[name] = None
                out.append((key[0], row_id, text, held[name][0], known))
            yield pd.DataFrame(out, columns=["shard", "row_id", "text", "result", "remembered"])
        for name in before.keys() - held.keys():
            self.kept.removeKey((name,))
        for name, value in held.items():
            if before.get(name) != value:
                self.kept.updateValue((name,), value)
        self.clock.update((t,))

    def close(self) -> None:
        pass


def remembered(rows: DataFrame, compute: Callable[[str | None], str | None], capacity: int = 256, shards: int = 8) -> DataFrame:
    """shard, row_id, text, result, remembered, of a stream of (row_id, text).
    Needs the RocksDB state store (``STORE``, ``ROCKS``) in the session."""
    dealt = rows.select(F.pmod(F.xxhash64("text"), F.lit(shards)).alias("shard"), "row_id", "text")
    return dealt.groupBy("shard").transformWithStateInPandas(Memo(compute, capacity), "shard bigint, row_id bigint, text string, result string, remembered boolean", "append", "none")
