"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are tokenised where they lie; only piece lengths move. Pieces are
dealt at random to shards of bounded size; every shard is packed by several
islands, each a group of its own with a small population of groupings made by
best fit in random order. A crossover injects the best-filled bins of one
parent into another, drops the bins that now hold duplicates, opens some of the
loosest, and puts the displaced pieces back by best fit, long ones first.
Between epochs every island gets the elite of its neighbour in a ring. An
island stops early only at the lower bound, the pieces' tokens divided by the
size of a sequence. The loosest bins of
all shards are packed again together in a few wider shards, so a shard's last,
half-empty bin costs nothing at scale.

Edge cases: null and empty texts are one end token; a document longer than a
sequence is cut into whole sequences and a rest; equal doc_ids are packed as
separate documents; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, spread, stored

VOCABULARY = "word_bpe_49k.json"
_CACHE: dict[str, TokenTable] = {}


class TokenTable:
    """Token ids of distinct words, kept while a worker lives and emptied when
    it holds ``most`` words. The tokenizer cuts at white space before anything
    else, so a word's ids don't depend on its neighbours."""

    def __init__(self, path: str, most: int = 3_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a special token's string in a text gives that token, as encode() does
        self.most = most
        self.ending = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ending[i] = token.endswith("</w>")
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        plain = [i for i, w in enumerate(words) if w.isalpha()]  # one pre-token, so one token with an end mark
        other = sorted(set(range(len(words))) - set(plain))
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        for at in range(0, len(plain), 500):
            some = plain[at : at + 500]
            got = np.array(self.tokenizer.encode(" ".join([words[i].decode() for i in some]), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(self.ending[got])[:-1] + 1
            parts = np.split(got, cut)
            if len(parts) != len(some):
                other += some
                continue
            for i, part in zip(some, parts):
                ids[i] = part
        # several pre-tokens: their number is not known beforehand, offsets tell
        for at in range(0, len(other), 500):
            some = other[at : at + 500]
            texts = [words[i].decode("utf-8", "replace") for i in some]
            begin = np.cumsum([0] + [len(t) + 1 for t in texts])
            encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            got = np.array(encoded.ids, np.uint32)
            where = np.array([a for a, _ in encoded.offsets], np.int64)
            first = np.searchsorted(where, begin)
            for k, i in enumerate(some):
                ids[i] = got[first[k] : first[k + 1]]
        count = np.array([len(x) for x in ids], np.int64)
        start = len(self.ids) + np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
        self.ids = np.concatenate([self.ids, *ids])
        order = np.argsort(np.concatenate((self.keys, keys)), kind="stable")
        self.start = np.concatenate((self.start, start))[order]
        self.count = np.concatenate((self.count, count))[order]
        self.keys = np.concatenate((self.keys, keys))[order]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and how many each text has."""
        words = Words(texts)
        if not len(words.key):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        keys, first, inverse = np.unique(words.key, return_index=True, return_inverse=True)
        known = np.isin(keys, self.keys, assume_unique=True)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.most:
                self.clear()
                known[:] = False
            new = np.flatnonzero(~known)
            self.learn(keys[new], [words.bytes_of(i) for i in first[new]])
        at = np.searchsorted(self.keys, keys)[inverse]
        count = self.count[at]
        total = np.concatenate(([0], np.cumsum(count)))
        return self.ids[spread(self.start[at], count)], np.diff(total[words.first])


def pieces(docs: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        table = _CACHE.get(path) or _CACHE.setdefault(path, TokenTable(path))
        for batch, texts in chunks(batches):
            ids, counts = table.encode(texts)
            doc, piece, start, length, crc = [], [], [], [], []
            at = 0
            for i, (doc_id, n) in enumerate(zip(batch.column("doc_id").to_pylist(), counts.tolist())):
                own = np.append(ids[at : at + n], end_id).astype("<u4")
                at += n
                for p, a in enumerate(range(0, len(own), size)):
                    part = own[a : a + size]
                    doc.append(doc_id), piece.append(p), start.append(a), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, order: np.ndarray, room: list[int], first_new: int, size: int) -> np.ndarray:
    """The bin of each piece in ``order``: the open bin with the least room
    that takes it, else a new one. ``room``: of the bins opened so far."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    bins = np.empty(len(order), np.int64)
    fresh = first_new
    for k, i in enumerate(order):
        n = int(lengths[i])
        at = bisect_left(free, (n, -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b = size, fresh
            fresh += 1
        bins[k] = b
        if r > n:
            insort(free, (r - n, b))
    return bins


def quality(lengths: np.ndarray, bins: np.ndarray, size: int) -> float:
    """Falkenauer's fitness: the mean squared fill of the bins."""
    fill = np.bincount(bins, weights=lengths)
    fill = fill[fill > 0] / size
    return float(np.mean(fill**2))


def cross(lengths: np.ndarray, into: np.ndarray, donor: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Child of two groupings: well-filled bins of the donor whole, the bins
    of the other that they don't touch, and the rest by best fit."""
    fill = np.bincount(donor, weights=lengths, minlength=donor.max() + 1) / size
    chosen = (fill > 0) & (rng.random(len(fill)) < 0.5 * fill**4)
    injected = chosen[donor]
    touched = np.zeros(into.max() + 1, bool)
    touched[into[injected]] = True
    held = np.bincount(into, weights=lengths, minlength=len(touched)) / size
    loose = held < min(0.9995, float(np.quantile(held[held > 0], rng.uniform(0.1, 0.9))))  # mutation: open the loosest too
    touched |= loose
    kept = ~injected & ~touched[into]
    child = np.full(len(lengths), -1, np.int64)
    _, a = np.unique(donor[injected], return_inverse=True)
    child[injected] = a
    n = a.max() + 1 if len(a) else 0
    _, b = np.unique(into[kept], return_inverse=True)
    child[kept] = b + n
    n += b.max() + 1 if len(b) else 0
    lost = np.flatnonzero(child < 0)
    if len(lost):
        room = (size - np.bincount(child[child >= 0], weights=lengths[child >= 0], minlength=n)).astype(np.int64).tolist() if n else []
        lost = lost[np.argsort(-lengths[lost] * (1 + 0.05 * rng.random(len(lost))), kind="stable")]
        child[lost] = best_fit(lengths, lost, room, n, size)
    return child


def evolve(lengths: np.ndarray, groups: list[np.ndarray], size: int, population: int, generations: int, seed: int) -> tuple[np.ndarray, int]:
    """The best grouping of one island after some generations that start from
    ``groups`` and random ones, and the number of crossovers made."""
    rng = np.random.default_rng(seed)
    lower = -(-int(lengths.sum()) // size)
    groups = list(groups)
    while len(groups) < population:
        order = rng.permutation(len(lengths))
        grouping = np.empty(len(lengths), np.int64)
        grouping[order] = best_fit(lengths, order, [], 0, size)
        groups.append(grouping)
    score = [quality(lengths, g, size) for g in groups]
    crossings = 0
    for _ in range(generations if len(groups) > 1 else 0):
        if len(np.unique(groups[int(np.argmax(score))])) == lower:
            break
        i, j = rng.permutation(len(groups))[:2]
        child = cross(lengths, groups[i], groups[j], size, rng)
        crossings += 1
        worst = int(np.argmin(score))
        got = quality(lengths, child, size)
        if got > score[worst]:
            groups[worst], score[worst] = child, got
    return groups[int(np.argmax(score))], crossings


def island_states(items: DataFrame, size: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """The elite of every island of every shard of ``items`` (shard, doc_id,
    piece, length, salt): shard, island, score, crossings (so far), items
    (lengths in the order of doc_id, piece, salt) and bins."""
    layout = "shard long, island int, score double, crossings long, items binary, bins binary"

    def state(key, lengths, best, crossings):
        made = (int(key[0]), int(key[1]), quality(lengths, best, size), crossings, lengths.astype("<i4").tobytes(), best.astype("<i4").tobytes())
        return pd.DataFrame([made], columns=["shard", "island", "score", "crossings", "items", "bins"])

    def begin(key, frame):
        frame = frame.sort_values(["doc_id", "piece", "salt"])
        lengths = frame["length"].to_numpy(np.int64)
        return state(key, lengths, *evolve(lengths, [], size, population, generations, 1000 * int(key[0]) + int(key[1])))

    def meet(key, frame):
        frame = frame.sort_values("guest")
        lengths = np.frombuffer(frame["items"].iloc[0], "<i4").astype(np.int64)
        groups = [np.frombuffer(b, "<i4").astype(np.int64) for b in frame["bins"]]
        best, crossings = evolve(lengths, groups, size, population, generations, 104729 * int(key[0]) + int(key[1]))
        return state(key, lengths, best, int(frame["crossings"].iloc[0]) + crossings)

    ids = F.explode(F.array(*[F.lit(k) for k in range(islands)]))
    made = items.select("shard", "doc_id", "piece", "length", "salt", ids.alias("island")).groupBy("shard", "island").applyInPandas(begin, layout)
    for _ in range(epochs - 1):
        if islands > 1:
            made = stored(made, "islands")
            guests = made.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")).withColumn("guest", F.lit(True))
            made = made.withColumn("guest", F.lit(False)).unionByName(guests)
        else:
            made = made.withColumn("guest", F.lit(False))
        made = made.groupBy("shard", "island").applyInPandas(meet, layout)
    return made


def _islands(items: DataFrame, size: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """``items`` with the bin of each in its shard, by the shard's best elite."""
    state = island_states(items, size, islands, epochs, population, generations)
    best = state.groupBy("shard").agg(F.max_by("bins", F.struct("score", -F.col("island"))).alias("bins"))

    def place(key, left, right):
        order = np.lexsort((left["salt"].to_numpy(), left["piece"].to_numpy(), left["doc_id"].to_numpy()))
        left = left.iloc[order].reset_index(drop=True)
        bins = np.frombuffer(right["bins"][0], "<i4").astype(np.int64)
        left["bin"] = bins
        length = left["length"].to_numpy(np.int64)
        by = np.argsort(bins, kind="stable")
        before = np.cumsum(length[by]) - length[by]
        new = np.concatenate(([True], bins[by][1:] != bins[by][:-1]))
        offset = np.empty(len(left), np.int64)
        offset[by] = before - before[np.flatnonzero(new)][np.cumsum(new) - 1]
        left["offset"] = offset
        fill = np.bincount(bins, weights=length)
        left["fill"] = fill[bins].astype(np.int64)
        return left[["doc_id", "piece", "start", "length", "ids_crc32", "salt", "shard", "bin", "offset", "fill"]]

    return items.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, shard long, bin long, offset long, fill long")


def pack(
    docs: DataFrame,
    path: str | None = None,
    end_id: int = 1,
    size: int = 4096,
    shard_items: int = 4000,
    islands: int = 2,
    epochs: int = 2,
    population: int = 4,
    generations: int = 20,
) -> DataFrame:
    """Pack all documents into as few sequences of ``size`` tokens as possible.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. ``shard_items`` bounds what one task packs at a time;
    the number of shards follows the number of pieces.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    every = stored(pieces(docs, path, end_id, size).withColumn("salt", F.monotonically_increasing_id()), "pieces")
    full = every.where(F.col("length") == size)
    loose = every.where(F.col("length") < size)
    n = loose.count()
    shards = max(1, -(-n // shard_items))
    dealt = loose.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(shards)).cast("long"))
    packed = _islands(dealt, size, islands, epochs, population, generations)
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if shards > 1:
        packed = stored(packed, "packed")
        slack = F.col("fill") < int(size * 0.98)
        open_ = packed.where(slack).select(*out, "salt")
        again = max(1, -(-open_.count() // shard_items))
        second = _islands(open_.withColumn("shard", F.pmod(F.xxhash64("salt", "doc_id"), F.lit(again)).cast("long")), size, islands, epochs, population, generations)
        done = packed.where(~slack)
    else:
        second, done = packed, None
    one = F.col("shard") * (1 << 24) + F.col("bin")
    result = second.select(*out, (one * 3).alias("sequence_id"), "offset")
    if done is not None:
        result = result.unionByName(done.select(*out, (one * 3 + 1).alias("sequence_id"), "offset"))
    return result.unionByName(full.select(*out, (F.col("salt") * 3 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
