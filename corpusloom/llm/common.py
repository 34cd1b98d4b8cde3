"""What the operators of this subpackage share.

Word rule used everywhere here: a word is a maximal run of bytes outside
``\\x20`` and ``\\x09-\\x0D``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CHUNK = 2 << 20  # bytes of text that a task holds in numpy arrays at a time
SIEVE = 24  # a sieve has 2**SIEVE bits, in 2**18 rows, at most

_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_MULT, -1, 1 << 64)
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; in a session
    without that setting (tests) a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it reread:
    later stages neither recompute it nor depend on an executor's disk. Its
    shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.parquet(path)
    table.stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more: what was made
    from them must be stored as well by then."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sieve(keys: DataFrame, most: int = SIEVE) -> Callable[[DataFrame, str], tuple[DataFrame, DataFrame]]:
    """To be put before a join with ``keys`` (a stored table of one column of
    longs), so that rows without a partner aren't shuffled: parts a table by
    its column of longs (not null) into rows that may have a partner (all that
    have one, and by chance others) and rows that have none.

    It is a bitmap of the keys' hashes, of eight to sixteen bits a key, which
    is broadcast in words of 64 bits. From ``2**most`` bits on it stays that
    large and lets more pass, with the same rows after the join.
    """
    size = 1 << min(most, max(16, (8 * keys.count()).bit_length()))
    place = lambda column: F.pmod(F.xxhash64(column), F.lit(size))
    at = keys.select(place(F.col(keys.columns[0])).alias("at"))
    words = at.groupBy(F.shiftright("at", 6)).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")))

    def parted(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        word, bits = fresh(df, "_word"), fresh(df, "_bits")
        known = df.join(F.broadcast(words.toDF(word, bits)), F.shiftright(place(F.col(column)), 6) == F.col(word), "left")
        bit = F.getbit(F.coalesce(bits, F.lit(0).cast("long")), (place(F.col(column)) % 64).cast("int"))
        return known.where(bit == 1).drop(word, bits), known.where(bit == 0).drop(word, bits)

    return parted


def without(df: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` (long, not null) isn't in ``dropped`` (a
    stored table of one column of longs). Only rows that may be among them are
    shuffled."""
    maybe, sure = sieve(dropped)(df, key)
    other = fresh(df, "_dropped")
    return sure.union(maybe.join(dropped.toDF(other), F.col(key) == F.col(other), "left_anti"))


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def words_of(text):
    """Native array of the words of a text column; null gives no words."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(flat, " "), "")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        for k, base in enumerate((_MULT, _INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS[0], _POWERS[1]


class Words:
    """Words of a list of texts as numpy arrays.

    ``start``/``end`` are byte positions in ``data`` (lower-cased A-Z unless
    ``lower`` is false), ``key`` a 64-bit polynomial hash, ``doc`` the text a
    word belongs to, ``first`` the index of each text's first word.
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        if lower:
            data = LOWER[data]
        self.data = data
        space = _IS_SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[::2], edge[1::2]
        up, down = powers(len(data))
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
        self.key = (total[self.end] - total[self.start]) * down[self.start]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def bytes_of(self, word: int) -> bytes:
        return self.data[self.start[word] : self.end[word]].tobytes()


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indexes start[i], start[i]+1, ... count[i] of them, for every i."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(total) + shift


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with about ``most`` bytes of text each (a longer
    text comes alone), with the texts as bytes; null is empty."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        listed = lambda at, n: [t or b"" for t in texts.slice(at, n).to_pylist()]  # noqa: E731, B023
        at = size = 0
        for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
            if i > at and size + n > most:
                yield batch.slice(at, i - at), listed(at, i - at)
                at, size = i, 0
            size += n
        if len(texts) > at:
            yield batch.slice(at), listed(at, len(texts) - at)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node that has an edge.

    ``edges``: columns ``a``, ``b`` (long), both directions not needed.
    Alternates large-star and small-star; every round is a grouping of edges
    cut by ``checkpoint()``, so no component meets in one task: a node's
    neighbours are only aggregated (min) and joined back.
    """
    pairs = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large-star: every larger neighbour of a node goes to the node's minimum
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: every smaller neighbour, and the node, go to the minimum
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        pairs = checkpointed(small)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state


def joined_components(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """``connected_components`` after more edges have come: only the graph of
    the components that they connect is searched anew."""
    up = reached.select(F.col("node").alias("a"), F.col("component").alias("x"))
    ends = edges.join(up, "a", "left").join(up.toDF("b", "y"), "b", "left")
    top = connected_components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    moved = reached.join(top.toDF("component", "to"), "component", "left")
    return moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(top)
