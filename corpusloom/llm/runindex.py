"""Repeated-substring removal with run-length (r-index style) indexes.

A byte goes when a ``span``-byte string over it also starts earlier (smaller
doc_id, or the same document and an earlier start).

1. Anchors. Of the ``span - K + 1`` K-byte strings inside a ``span``-byte
   string the one with the smallest hash is its anchor, so equal strings have
   equal anchors at equal places (minimizers). A document gets an anchor every
   few dozen bytes; anchors that occur once anywhere can't be in a repeat.
2. Neighbourhoods. All ``span``-byte strings of which one anchor is the
   smallest start in one stretch in front of it; the bytes from the first to
   the end of the last are its neighbourhood. Equal neighbourhoods are grouped by hash: each but the earliest
   goes whole, and only the earliest of each is looked at further. So the
   volume follows the distinct content, not the copies.
3. Run-length index. Anchors are dealt to buckets of bounded size; a bucket's
   distinct neighbourhoods are concatenated and their run-compressed
   Burrows-Wheeler transform is built. Only the suffixes at the ends of runs
   are sampled, with their common prefixes; from these samples the matching
   statistics of every other position follow (inside a run the predecessor
   moves along and the match is one byte shorter). Positions whose match has
   ``span`` bytes or more form chains of equal strings; all but the earliest
   of a chain go.
4. An anchor whose distinct neighbourhoods have more bytes than a bucket (a
   line that a large part of the corpus shares) would outgrow it. Its
   neighbourhoods are cut into ``WAYS`` shorter ones, by how far in front of the
   anchor a string starts, and these go by the bytes that all strings of their
   cut have, so equal strings stay together; steps 2 to 4 are done again with
   them. A cut of one start ends it, its strings being equal. The at most
   ``LISTED`` cut neighbourhoods that have more than their share of all rows are
   looked up where they are read.

Edge cases: null and empty texts keep nothing and lose nothing; documents
shorter than ``span`` lose nothing; matches never cross documents; rows with
equal doc_ids and different texts are documents of their own, in the order of
a hash of the text (a null doc_id comes last); rows equal in both count as one
document that is seen once, so they don't remove each other; an empty table
gives an empty result; further columns are ignored. 64-bit hashes of anchors
and neighbourhoods aren't verified: among 10**9 distinct ones the chance that
any two share a hash is 3 %.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, powers, stored

SPAN, K = 100, 24
#: Cut neighbourhoods that are sent to every task, at most.
LISTED = 1 << 16
WAYS = 4
_BYTE = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x ^= x >> np.uint64(29)
    x *= _ODD
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of substrings of an array of 64-bit symbol codes."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.total = np.empty(len(codes) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(codes * up[: len(codes)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]

    def all(self, size: int) -> np.ndarray:
        """Of every substring of this size."""
        return (self.total[size:] - self.total[:-size]) * self.down[: len(self.total) - size]


def _sliding(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every window of ``size`` values."""
    take = np.minimum if least else np.maximum
    width = 1
    while 2 * width <= size:
        x = take(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return take(x[: len(x) - rest], x[rest:]) if rest else x


def find_anchors(texts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, ...]:
    """Of the texts' anchors: text, where its neighbourhood begins and how long
    it is, how far in it the anchor is, hash, and the hash of the neighbourhood."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.zeros(0, np.int64)
    if len(data) < span:
        return empty, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    hashes = Hashes(_BYTE[data])
    gram = _mix(hashes.all(K))
    small = (gram >> np.uint64(32)).astype(np.uint32)
    width = span - K + 1
    low = _sliding(small, width, True)  # of the string that starts here
    valid = np.zeros(len(low) + 1, np.int32)
    fit = np.flatnonzero(sizes >= span)
    valid[begin[fit]] += 1
    np.subtract.at(valid, begin[fit] + sizes[fit] - span + 1, 1)
    low[np.cumsum(valid[:-1]) == 0] = 0
    pad = np.zeros(width - 1, np.uint32)
    high = _sliding(np.concatenate((pad, low, pad)), width, False)[: len(small)]
    place = np.flatnonzero((high == small) & (high > 0))
    # stretches of starts with one minimum, and the one that holds each anchor
    edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    last = np.append(edge[1:], len(low)) - 1
    order = np.argsort((low[edge].astype(np.uint64) << np.uint64(32)) + last.astype(np.uint64))
    edge, last = edge[order], last[order]
    wanted = (small[place].astype(np.uint64) << np.uint64(32)) + np.maximum(place - width + 1, 0).astype(np.uint64)
    at = np.searchsorted((low[edge].astype(np.uint64) << np.uint64(32)) + last.astype(np.uint64), wanted)
    text = np.searchsorted(begin, place, side="right") - 1
    start = np.maximum(np.maximum(edge[at], place - width + 1), begin[text])
    end = np.minimum(last[at], place) + span
    around = _mix(hashes.of(start, end) + _mix(((place - start) * 4096 + (end - place)).astype(np.uint64)))
    return text, start - begin[text], end - start, place - start, gram[place], around


def anchors(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc, low and size (the neighbourhood), lead (bytes of it in front of the
    anchor), anchor, around (hashes)."""

    def run(batches):
        for batch, texts in chunks(batches, most=512 << 10):
            text, low, size, lead, anchor, around = find_anchors(texts, span)
            doc = batch.column("doc").to_numpy(zero_copy_only=False)[text] if len(text) else text
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(low.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(around.view(np.int64))], ["doc", "low", "size", "lead", "anchor", "around"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, low int, size int, lead int, anchor long, around long")


class RunIndex:
    """Run-compressed BWT of a list of byte strings, kept as samples at the
    ends of its runs: ``head`` (text positions that start a run in suffix
    order), ``before`` (the suffix in front of it) and ``common`` (bytes both
    share)."""

    def __init__(self, bodies: list[bytes]):
        n = len(bodies)
        sizes = np.array([len(b) + 1 for b in bodies], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        symbols = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) + n
        symbols[self.begin[1:] - 1] = np.arange(n)  # every string ends in a symbol of its own
        order = self._suffixes(symbols, n)
        last = symbols[order - 1]
        starts = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        self.runs = len(starts)
        self.head = order[starts]
        self.before = order[starts - 1]
        self.before[0] = self.head[0]
        self.common = self._common(symbols, self.head, self.before, int(sizes.max()))
        self.common[0] = 0
        by = np.argsort(self.head)
        self.head, self.before, self.common = self.head[by], self.before[by], self.common[by]
        self.size = len(symbols)

    @staticmethod
    def _suffixes(symbols: np.ndarray, strings: int) -> np.ndarray:
        """Suffix order by prefix doubling; only suffixes that still tie are
        sorted again."""
        n, width = len(symbols), 7
        code = np.maximum(symbols - strings + 1, 0).astype(np.uint64)  # a string's end is 0
        packed, inside = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(width):  # seven symbols at once, of one string only
            packed[: n - k] |= np.where(inside[: n - k], code[k:], np.uint64(0)) << np.uint64(9 * (width - 1 - k))
            inside[: n - k] &= code[k:] > 0
        order = np.argsort(packed, kind="stable")
        key = packed[order]
        # suffixes that end inside differ by their string, so by position
        new = np.concatenate(([True], (key[1:] != key[:-1]) | ~inside[order][1:]))
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        while True:
            ties = np.flatnonzero(~new)
            if not len(ties):
                return order
            group = np.zeros(n, bool)
            group[ties] = group[ties - 1] = True
            at = np.flatnonzero(group)  # places in the order, group by group
            some = order[at]
            head, later = rank[some], rank[np.minimum(some + width, n - 1)]
            key = head * n + later
            by = np.argsort(key, kind="stable")
            key, some = key[by], some[by]
            order[at] = some
            fresh = np.concatenate(([True], key[1:] != key[:-1]))
            new[at] = fresh
            rank[some] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            width *= 2

    @staticmethod
    def _common(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        hashes = Hashes(_mix(symbols.astype(np.uint64) + np.uint64(1)))
        n = len(symbols)
        length = np.zeros(len(a), np.int64)
        for step in (1 << k for k in range(most.bit_length() - 1, -1, -1)):
            fits = np.maximum(a, b) + length + step <= n
            x, y = np.where(fits, a + length, 0), np.where(fits, b + length, 0)
            same = fits & (hashes.of(x, np.where(fits, x + step, 0)) == hashes.of(y, np.where(fits, y + step, 0)))
            length[same] += step
        return length

    def matching(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position the position in front of it in suffix order and
        how many bytes match there, from the samples alone."""
        at = np.arange(self.size)
        sample = np.searchsorted(self.head, at, side="right") - 1
        moved = at - self.head[sample]
        return self.before[sample] + moved, np.maximum(self.common[sample] - moved, 0)

    def later_copies(self, age: np.ndarray, span: int) -> np.ndarray:
        """Positions whose next ``span`` bytes also start where ``age`` is
        smaller."""
        front, match = self.matching()
        at = np.arange(self.size)
        root = np.where(match >= span, front, at)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        oldest = np.full(self.size, np.iinfo(np.int64).max)
        np.minimum.at(oldest, root, age)
        return np.flatnonzero(age > oldest[root])


def _joined(doc: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans that strings of ``span`` bytes at these starts cover."""
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + span)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return doc[first], start[first], start[last] + span


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc, low, size, lead, anchor, hot) with the neighbourhood's
    bytes and where they begin."""
    lists = wanted.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set(F.struct("low", "size", "lead", "anchor", "hot")).alias("wanted"))
    both = docs.join(lists, F.col("doc") == F.col("_doc")).select("doc", "text", "wanted")

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for doc, text, some in zip(batch.column("doc").to_pylist(), texts, batch.column("wanted").to_pylist()):
                for x in some:
                    low = x["low"]
                    for column, value in zip(out, (doc, low, x["lead"], x["anchor"], x["hot"], text[low : low + x["size"]])):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()))], ["doc", "begin", "lead", "anchor", "hot", "body"])

    return both.mapInArrow(run, "doc long, begin int, lead int, anchor long, hot boolean, body binary")


def _cuts(hot: DataFrame, span: int) -> DataFrame:
    """``hot`` (doc, begin, lead, low, high, body: neighbourhoods whose strings
    start ``low`` to ``high`` bytes in front of the anchor) cut into ``WAYS``
    such ranges, with the hashes of the bytes that all strings of a range have
    (anchor) and of the body (around)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            size = np.array([len(b) for b in bodies], np.int64)
            base = np.cumsum(size) - size
            hashes = Hashes(_BYTE[np.frombuffer(b"".join(bodies), np.uint8)])
            begin, lead, low, high = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("begin", "lead", "low", "high"))
            width = -(-(high - low + 1) // WAYS)
            for way in range(WAYS):
                a = low + way * width
                b = np.minimum(a + width - 1, high)
                first, last = np.minimum(lead, b), np.maximum(lead - (size - span), a)
                some = np.flatnonzero((a <= b) & (first >= last))
                if not len(some):
                    continue
                at, a, b, first, last = base[some] + lead[some], a[some], b[some], first[some], last[some]
                anchor = _mix(hashes.of(at - a, at - b + span) + _mix((a * 4096 + b).astype(np.uint64)))
                around = _mix(hashes.of(at - first, at - last + span) + _mix((first * 4096 + last).astype(np.uint64)))
                start, end = lead[some] - first, lead[some] - last + span
                cut = [bodies[k][x:y] for k, x, y in zip(some.tolist(), start.tolist(), end.tolist())]
                numbers = [pa.array(x.astype(np.int32)) for x in (begin[some] + start, first, a, b)]
                yield pa.record_batch([batch.column("doc").take(pa.array(some)), *numbers, pa.array(anchor.view(np.int64)), pa.array(around.view(np.int64)), pa.array(cut, pa.binary())], ["doc", "begin", "lead", "low", "high", "anchor", "around", "body"])

    columns = "doc", "begin", "lead", "low", "high", "body"
    return hot.select(*columns).mapInArrow(run, "doc long, begin int, lead int, low int, high int, anchor long, around long, body binary")


def _cut_until_cold(near: DataFrame, whole: DataFrame, span: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``whole`` with the spans of cut neighbourhoods that are copies of earlier
    ones, and the neighbourhoods, cut or not, that buckets take (doc, begin,
    anchor, body)."""
    taken = "doc", "begin", "anchor", "body"
    later = lambda rows: rows.where("doc <> _doc or begin <> _begin").select("doc", F.col("begin").alias("low"), (F.col("begin") + F.length("body")).alias("high"))
    cold, hot = near.where("not hot").select(*taken), near.where("hot").withColumns({"low": F.lit(0), "high": F.lit(span - K)})
    while not hot.isEmpty():
        made = stored(_cuts(hot, span), "cuts")
        first = F.min(F.struct("doc", "begin", "lead", "low", "high", "body")).alias("first")
        groups = stored(made.groupBy("anchor", "around").agg(first, F.count("*").alias("n")), "cut-groups")
        copies = groups.where("n > 1").select("anchor", "around", "n", F.col("first.doc").alias("_doc"), F.col("first.begin").alias("_begin"))
        share = (copies.agg(F.sum("n")).first()[0] or 0) // LISTED
        often, seldom = F.broadcast(copies.where(F.col("n") > share)), copies.where(F.col("n") <= share)
        rest = made.join(often.select("anchor", "around"), ["anchor", "around"], "left_anti")
        whole = whole.unionByName(later(made.join(often, ["anchor", "around"]))).unionByName(later(rest.join(seldom, ["anchor", "around"])))
        several = stored(groups.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.length("first.body")).alias("bytes")).where("kinds > 1"), "cut-kinds")
        left = stored(groups.join(several, "anchor").select("first.*", "anchor", (F.col("bytes") > bucket_bytes).alias("hot")), "cut-texts")
        cold, hot = cold.unionByName(left.where("not hot").select(*taken)), left.where("hot")
    return whole, cold


def repeated_spans(docs: DataFrame, span: int = SPAN, bucket_bytes: int = 1 << 20) -> DataFrame:
    """Spans (doc, low, high) whose bytes go; they may overlap."""
    found = anchors(docs, span)
    # each table that counts is stored before it is joined: a skewed join can then be split
    again = stored(found.groupBy("anchor").count().where("count > 1").select("anchor"), "repeated-anchors")
    hits = stored(found.join(again, "anchor"), "anchors")
    groups = hits.groupBy("anchor", "around").agg(F.min(F.struct("doc", "low", "size", "lead")).alias("first"), F.count("*").alias("n"))
    groups = stored(groups, "neighbourhoods")
    copies = groups.where("n > 1").select("anchor", "around", F.col("first.doc").alias("_doc"), F.col("first.low").alias("_low"))
    whole = hits.join(copies, ["anchor", "around"]).where("doc <> _doc or low <> _low").select("doc", "low", (F.col("low") + F.col("size")).alias("high"))
    several = stored(groups.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("first.size").alias("bytes")).where("kinds > 1"), "neighbourhood-kinds")
    hot = F.col("bytes") > bucket_bytes  # where the anchor is matters to these only
    wanted = groups.join(several, "anchor").select("first.doc", "first.low", "first.size", F.when(hot, F.col("first.lead")).otherwise(0).alias("lead"), "anchor", hot.alias("hot"))
    near = stored(_texts(docs, wanted), "neighbourhood-texts")
    whole, near = _cut_until_cold(near, whole, span, bucket_bytes)
    volume = near.agg(F.sum(F.length("body") + 1)).first()[0] or 0
    buckets = max(1, -(-int(volume) // bucket_bytes))

    def index(key, frame):
        frame = frame.sort_values(["doc", "begin", "anchor"])
        bodies = frame["body"].tolist()
        made = RunIndex(bodies)
        owner = np.repeat(np.arange(len(bodies)), np.diff(made.begin))
        start = frame["begin"].to_numpy(np.int64)[owner] + np.arange(made.size) - made.begin[owner]
        doc = frame["doc"].to_numpy(np.int64)
        _, number = np.unique(doc, return_inverse=True)
        at = made.later_copies(number[owner] * (1 << 33) + start, span)
        a, low, high = _joined(doc[owner[at]], start[at], span)
        return pd.DataFrame({"doc": a, "low": low.astype(np.int32), "high": high.astype(np.int32)})

    cold = near.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInPandas(index, "doc long, low int, high int")
    return whole.unionByName(cold)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``doc``, a number in the order of doc_id:
    doc_id itself where no two rows share one and none is null."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("doc", F.col("doc_id"))
    keys = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")).distinct()
    keys = keys.repartitionByRange(F.asc_nulls_last("_id"), "_hash").sortWithinPartitions(F.asc_nulls_last("_id"), "_hash")
    keys = stored(keys.withColumn("doc", F.monotonically_increasing_id()), "document-numbers")
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))).select("doc_id", "text", "doc")


def remove_repeats(docs: DataFrame, span: int = SPAN, **options) -> DataFrame:
    """doc_id, text (binary, what is kept), n_bytes, n_removed, n_spans of
    every document."""
    base = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    spans = repeated_spans(base, span, **options)
    cut = F.sort_array(F.collect_set(F.struct("low", "high")))
    both = base.join(spans.groupBy(F.col("doc").alias("_doc")).agg(cut.alias("spans")), F.col("doc") == F.col("_doc"), "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            kept, sizes, removed, runs = [], [], [], []
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for text, spans in zip(texts, batch.column("spans").to_pylist()):
                n = len(text)
                parts, at, gone, count, end = [], 0, 0, 0, -1
                for x in spans or ():
                    low, high = x["low"], min(x["high"], n)
                    if low > end:
                        count += 1
                    if high > at:
                        if low > at:
                            parts.append(text[at:low])
                        gone += high - max(low, at)
                        at = high
                    end = max(end, high)
                parts.append(text[at:])
                kept.append(b"".join(parts)), sizes.append(n), removed.append(gone), runs.append(count)
            yield pa.record_batch([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], ["doc_id", "text", "n_bytes", "n_removed", "n_spans"])

    return both.mapInArrow(run, "doc_id long, text binary, n_bytes long, n_removed long, n_spans long")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
