"""Near-duplicates through a byte-position inverted index with count filter.

A fingerprint is a row of positional bytes. Pairs that match must share at
least a known number of them: of SimHash's eight bytes ``8 - bits``, since
``bits`` differing bits touch at most as many bytes; of the 600 bytes of a wide
fingerprint ``LEAST_SHARED`` (below). The index has postings of byte positions
with their bytes; the shared positional bytes of pairs in a posting are
tallied, pairs that reach the minimum stay, and those are verified.

Postings of single bytes hold 1/256 of the corpus each, and tallying them makes
work grow with its square. So a posting is keyed by several positions at once,
chosen so that no pair of the minimum is missed:

* SimHash (64 bits): two of the four pairs of bytes. A pair that differs in
  two bytes shares two such pairs of bytes at least. Postings of more than
  ``MOST`` members (a large group of near copies) are keyed by two bytes more
  out of the other four, which still misses no pair; then a posting varies in
  16 bits only. There members are linked through neighbourhoods: values at two
  bits or less share a value that is one flip from both, or are one flip apart,
  so linking each value to the least member of every neighbourhood connects
  what all pairs would, in time linear in the members.
* Wide (five-word shingles, Jaccard similarity of 0.8): byte j is the low byte
  of the least shingle under the j-th of 600 hash orders, so two texts share it
  with the probability of their similarity. Postings are 75 bands of eight
  bytes. A pair at a similarity of 0.8 shares no band with a chance of 1e-6
  (at 0.85: 6e-11), and fewer than 432 of the 600 bytes with 5e-7; it then gets
  lost. What stays is verified on the whole shingle sets. The postings' most
  popular member (that with the most company over all its postings, so the
  original rather than one of its copies) is tried first: once for each other
  member, then for each posting that still has several components. Only where
  components remain are pairs across them tried, and a posting of more than
  ``MOST`` members is split by three bytes more before, in 4 ways: over all the
  bands that a pair can share this makes the chance of 1e-6 one of 2.4e-6, and
  5e-6 if split twice. Before all this, exactly, shingles that only one of the
  texts in postings has are told: a text with more than a fifth of them links to
  none and goes. Of the others each row of a posting holds how many shingles
  other texts have too, in ``CLASSES`` classes by hash; the lesser counts of two
  texts add up to no less than what they share, and a pair across components is
  made only if that can be enough.

Equal fingerprints (wide: equal shingle sets) are one entry.

Edge cases: null and empty texts have fingerprint zero and link to each other
(wide: texts without a word are one group); texts shorter than a shingle use
the whole word sequence as their only shingle; repeated shingles count in
SimHash as often as they occur, in sets once; letters A-Z count as a-z; equal
doc_ids keep a row each, and ``drop_near_copies`` tells rows apart by a number,
so doc_id can be null or repeated; an empty table gives an empty result.
Shingle hashes of 64 bits aren't verified against the words.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, connected_components, forget, fresh, joined_components, sieve, spread, stored, without

MOST = 64
SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND = 75, 8
LEAST_SHARED = 432
#: Into so many classes shingles are counted, to bound what two texts share.
CLASSES = 32
_RNG = np.random.default_rng(20240311)
_TURN = _RNG.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint_of(shingle_hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes (none: zero)."""
    if not len(shingle_hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingle_hashes), 1 << 16):
        part = shingle_hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * ones > len(shingle_hashes))
    return sum(1 << int(b) for b in set_bits)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (long, the 64 bits) of every whole text."""

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch, texts in chunks(batches):
            words = Words(texts)
            # the words of a text joined by single spaces
            length = words.end - words.start
            ends = np.cumsum(length + 1) - 1
            starts = ends - length
            joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
            keep = np.ones(len(joined), bool)
            keep[ends] = False
            inside = np.zeros(len(words.data) + 1, np.int8)
            inside[words.start] = 1
            inside[words.end] -= 1
            joined[keep] = words.data[np.cumsum(inside[:-1]).astype(bool)]
            flat = joined.tobytes()
            begins, stops = starts.tolist(), ends.tolist()
            out = []
            for first, n in zip(words.first.tolist(), words.count.tolist()):
                if n == 0:
                    out.append(0)
                    continue
                last = first + max(n - shingle + 1, 1)
                width = min(shingle, n) - 1
                hashes = [digest(flat[i:j], seed) for i, j in zip(begins[first:last], stops[first + width : last + width])]
                out.append(fingerprint_of(np.array(hashes, np.uint64)))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def _shared(column, positions: tuple[int, ...]):
    """The bytes at these positions of a fingerprint (a long)."""
    mask = sum(255 << (8 * p) for p in positions)
    return column.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _entries(table: DataFrame, keep: list[str], choices: list[tuple[int, ...]], number: str, shared: str) -> DataFrame:
    """One row for each choice of byte positions."""
    made = F.array(*[F.struct(F.lit(k).alias(number), _shared(F.col("fingerprint"), c).alias(shared)) for k, c in enumerate(choices)])
    return table.select(*keep, "fingerprint", F.explode(made).alias("e")).select(*keep, "fingerprint", f"e.{number}", f"e.{shared}")


def pairs_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j), i < j, of all pairs inside consecutive groups."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(first)) - first
    more = np.repeat(sizes, sizes) - place - 1
    i = np.repeat(np.arange(len(first)), more)
    return i, spread(np.arange(len(first)) + 1, more)


def tallied(members: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs inside groups of fingerprints that share enough positional bytes
    and differ in at most ``bits`` bits."""
    i, j = pairs_of(sizes)
    own = members.astype("<u8").view(np.uint8).reshape(-1, 8)
    shared = (own[i] == own[j]).sum(1)
    some = np.flatnonzero(shared >= 8 - bits)
    some = some[np.bitwise_count(members[i[some]] ^ members[j[some]]) <= bits]
    return members[i[some]], members[j[some]]


def neighbours(members: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the distinct members of one posting that connect everything
    within ``bits`` (2) differing bits; for other ``bits`` all pairs."""
    members = np.sort(members)
    if bits != 2:
        return tallied(members, np.array([len(members)]), bits)
    varying = np.bitwise_or.reduce(members ^ members[0])
    flips = np.array([0] + [1 << b for b in range(64) if int(varying) >> b & 1], np.uint64)
    centre = (members[:, None] ^ flips[None, :]).ravel()
    member = np.repeat(np.arange(len(members)), len(flips))
    order = np.lexsort((member, centre))
    centre, member = centre[order], member[order]
    new = np.concatenate(([True], centre[1:] != centre[:-1]))
    lead = member[np.flatnonzero(new)][np.cumsum(new) - 1]
    pair = np.unique(np.stack([lead, member])[:, lead != member], axis=1)
    return members[pair[0]], members[pair[1]]


def links(distinct: DataFrame, bits: int = 2, most: int = MOST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at ``bits`` (2 at most) or
    fewer differing bits, enough to connect all that link."""
    if not 0 <= bits <= 2:
        raise ValueError("the index covers 0 to 2 differing bits")
    twos = [(0, 1), (2, 3), (4, 5), (6, 7)]
    choices = [x + y for x, y in combinations(twos, 2)]
    entries = _entries(distinct.select("fingerprint").repartition("fingerprint"), [], choices, "choice", "shared")
    by = ["choice", "shared"]
    sizes = stored(entries.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), "print-postings")
    inside = stored(entries.join(sizes, by), "print-entries")

    def few(frames):
        for frame in frames:
            lists = [np.asarray(x, np.int64).view(np.uint64) for x in frame["members"]]
            if lists:
                a, b = tallied(np.concatenate(lists), np.array([len(x) for x in lists]), bits)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def many(frames):
        for frame in frames:
            for members in frame["members"]:
                a, b = neighbours(np.asarray(members, np.int64).view(np.uint64), bits)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    members = F.collect_list("fingerprint").alias("members")
    small = inside.where(F.col("n") <= most).groupBy(*by).agg(members).select("members").mapInPandas(few, "a long, b long")
    # two of the other four bytes: whichever of the four aren't in a choice
    parts = []
    for k, choice in enumerate(choices):
        rest = [p for p in range(8) if p not in choice]
        large = inside.where((F.col("n") > most) & (F.col("choice") == k))
        parts.append(_entries(large, by, list(combinations(rest, 2)), "further", "bytes"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    groups = every.groupBy(*by, "further", "bytes").agg(members).where(F.size("members") > 1)
    large = groups.select("members").mapInPandas(many, "a long, b long")
    return small.unionByName(large).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (long) and component_id (smallest doc_id that the
    links reach) of every document."""
    prints = stored(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "distinct-prints")
    edges = links(distinct, bits)
    # the fingerprint is the node, so rows without an id link others as well,
    # and an id that stands in two groups doesn't join them
    reached = connected_components(edges)
    roots = reached.select(F.col("component").alias("node"), "component").distinct()
    reached = reached.unionByName(roots)
    linked = distinct.join(reached, distinct.fingerprint == reached.node).select("fingerprint", "component", "low")
    least = linked.groupBy("component").agg(F.min("low").alias("least"))
    moved = linked.join(least, "component").select("fingerprint", "least")
    classes = distinct.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("least", "low").alias("component_id"))
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex16(fingerprint):
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and key of every distinct shingle, sorted, and how many each
    text has."""
    words = Words(texts)
    width = np.minimum(words.count, size)
    number = np.where(words.count > 0, words.count - width + 1, 0)
    first = spread(words.first[:-1], number)
    length = np.repeat(width, number)
    key = np.full(len(first), 0x2545F4914F6CDD1D, np.uint64)
    for k in range(size):
        inside = k < length
        mixed = (key ^ words.key[np.where(inside, first + k, 0)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        key = np.where(inside, mixed, key)
    doc = np.repeat(np.arange(len(texts)), number)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[new], key[new], np.bincount(doc[new], minlength=len(texts))


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """row and the distinct shingles (hashes) of every text."""

    def run(batches):
        for batch, texts in chunks(batches):
            _, key, count = _sets(texts, shingle)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(key.view(np.int64)))
            yield pa.record_batch([batch.column("row"), lists], ["row", "shingles"])

    return docs.select("row", "text").mapInArrow(run, "row long, shingles array<long>")


def wide_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """row, doc_id, print (hash of the shingle set) and wide (the positional
    bytes) of every text."""

    def run(batches):
        for batch, texts in chunks(batches, most=1 << 20):
            _, key, count = _sets(texts, shingle)
            start = np.cumsum(count) - count
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), dtype=np.uint64)))
            whole = (total[start + count] - total[start]) ^ count.astype(np.uint64)
            wide = np.zeros((len(texts), len(_ODD)), np.uint8)
            some = np.flatnonzero(count)
            if len(some):
                for j, (turn, odd) in enumerate(zip(_TURN, _ODD)):
                    wide[some, j] = np.minimum.reduceat((key ^ turn) * odd, start[some]) & np.uint64(255)
            yield pa.record_batch([batch.column("row"), batch.column("doc_id").cast(pa.int64()), pa.array(whole.view(np.int64)), pa.array([w.tobytes() for w in wide], pa.binary())], ["row", "doc_id", "print", "wide"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, print long, wide binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """node, band (its number) and bytes of every band of a fingerprint."""
    cut = [F.struct(F.lit(k).cast("short").alias("band"), F.expr(f"substring(wide, {1 + k * BAND}, {BAND})").alias("bytes")) for k in range(BANDS)]
    return nodes.select("node", F.explode(F.array(*cut)).alias("e")).select("node", F.xxhash64("e.band", "e.bytes").alias("posting"))


def _likely(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node, shingles, size (their number) and common (how many of them, by
    class, another of ``nodes`` has as well) where enough are common for a link
    to one of them."""

    def run(batches):
        for batch in batches:
            lists = batch.column("shingles")
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            alone = batch.column("alone")
            fewer = alone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            common = np.zeros((batch.num_rows, CLASSES), np.int64)
            for number, values, sign in ((size, lists.flatten(), 1), (fewer, alone.flatten(), -1)):
                kind = values.to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(CLASSES)
                owner = np.repeat(np.arange(batch.num_rows), number)
                common += sign * np.bincount(owner * CLASSES + kind.astype(np.int64), minlength=common.size).reshape(common.shape)
            some = np.flatnonzero(common.sum(1) >= similarity * size - 1e-9)
            counts = pa.FixedSizeListArray.from_arrays(pa.array(common[some].ravel().astype(np.int32)), CLASSES).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(some)), lists.take(pa.array(some)), pa.array(size[some].astype(np.int32)), counts], ["node", "shingles", "size", "common"])

    met = sieve(nodes)(docs, "row")[0].join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    sets = stored(shingle_sets(met, shingle).withColumnRenamed("row", "node"), "near-met-sets")
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1").groupBy("node").agg(F.collect_list("s").alias("alone"))
    likely = stored(sets.join(alone, "node", "left").mapInArrow(run, "node long, shingles array<long>, size int, common array<int>"), "near-sets")
    forget(sets)
    return likely


def _enough(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, least: int) -> DataFrame:
    """The pairs (a, b) whose tally of shared positional bytes reaches
    ``least`` and whose shingle sets are similar enough."""

    def tally(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("wa", "wb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x == y).sum(1).astype(np.int32))], ["a", "b", "shared"])

    of = lambda side: nodes.select(F.col("node").alias(side), F.col("wide").alias(f"w{side}"))
    counted = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "wa", "wb").mapInArrow(tally, "a long, b long, shared int")
    near = stored(counted.where(F.col("shared") >= least), "near-pairs")
    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}"))
    both = F.size(F.array_intersect("sa", "sb"))
    enough = (1 + similarity) * both >= similarity * (F.size("sa") + F.size("sb")) - 1e-9
    edges = stored(near.join(of("b"), "b").join(of("a"), "a").where(enough).select("a", "b"), "near-edges")
    forget(near)
    return edges


def _open(postings: DataFrame, reached: DataFrame) -> DataFrame:
    """Postings (posting, node) whose members are in several components, with
    each node's component and their number of members."""
    parted = postings.join(reached, "node", "left").select("posting", "node", F.coalesce("component", "node").alias("component"))
    several = parted.groupBy("posting").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).where("low < high").select("posting", "members")
    several = stored(several, "near-several")
    out = stored(parted.join(several, "posting"), "near-open")
    forget(several)
    return out


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, least: int = LEAST_SHARED, most: int = MOST) -> DataFrame:
    """row, doc_id and group of every row of ``docs`` (row, doc_id, text; a
    stored table, ``row`` a key): groups are what pairs at ``similarity`` or
    more connect. ``least`` belongs to ``similarity``."""
    wide = stored(wide_fingerprints(docs, shingle), "near-wide")
    prints = stored(wide.select("row", "doc_id", "print"), "near-prints")
    lows = stored(prints.groupBy("print").agg(F.min("row").alias("node")), "near-lows")
    copies = stored(prints.join(lows, "print").where("row <> node").select("row"), "near-copies")
    nodes = stored(without(wide.select(F.col("row").alias("node"), "wide"), "node", copies), "near-nodes")
    forget(wide, copies)
    reached = stored(nodes.select("node", F.col("node").alias("component")).limit(0), "near-reached")
    tried = []

    def tested(pairs: DataFrame) -> None:
        nonlocal reached
        for before in tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = stored(pairs, "near-tried")
        if pairs.isEmpty():
            return
        tried.append(pairs)
        found = _enough(pairs, nodes, sets, similarity, least)
        if not found.isEmpty():
            old, reached = reached, stored(joined_components(reached, found), "near-reached")
            forget(old)
        forget(found)

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    postings = _bands(nodes)
    shared = stored(postings.groupBy("posting").agg(F.count("*").alias("members")).where("members > 1").select("posting"), "near-shared")
    met = stored(sieve(shared)(postings, "posting")[0].join(shared, "posting"), "near-met")
    both = stored(met.select("node").distinct(), "near-met-nodes")
    sets = _likely(both, docs, shingle, similarity)
    wanted, every = sets.select("node"), nodes
    nodes = stored(sieve(wanted)(every, "node")[0].join(wanted, "node", "left_semi"), "near-few-nodes")
    forget(both, every)
    postings, large = met.join(wanted, "node", "left_semi"), None
    for depth in range(4):
        sizes = stored(postings.groupBy("posting").agg(F.count("*").alias("members")).where("members > 1"), "near-sizes")
        postings = stored(postings.join(sizes, "posting"), "near-postings")
        forget(sizes, *([large] if large is not None else []))
        company = stored(postings.groupBy("node").agg(F.sum("members").alias("company")), "near-company")
        ranked = postings.join(company, "node")
        centres = stored(ranked.groupBy("posting").agg(F.max(F.struct("company", "node")).alias("centre")), "near-centres")
        best = postings.join(centres, "posting").groupBy("node").agg(F.max("centre").alias("centre"))
        tested(best.where("node <> centre.node").select(*ordered(F.col("node"), F.col("centre.node"))).distinct())
        left = _open(postings.select("posting", "node"), reached)
        forget(postings, company)
        pivots = left.join(centres.select("posting", F.col("centre.node").alias("centre")), "posting")
        own = left.select("posting", F.col("node").alias("centre"), F.col("component").alias("its"))
        pivots = pivots.join(own, ["posting", "centre"]).where("component <> its")
        tested(pivots.select(*ordered(F.col("node"), F.col("centre"))).distinct())
        before, left = left, _open(left.select("posting", "node"), reached)
        forget(before, centres)
        small = left.where(F.col("members") <= most) if depth < 3 else left
        small = small.join(sets.select("node", "size", "common"), "node")
        x = small.select("posting", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("size").alias("na"), F.col("common").alias("ma"))
        y = small.select("posting", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("size").alias("nb"), F.col("common").alias("mb"))
        both = F.expr("aggregate(zip_with(ma, mb, (p, q) -> least(p, q)), 0, (s, p) -> s + p)")
        within = (1 + similarity) * both >= similarity * (F.col("na") + F.col("nb")) - 1e-9
        tested(x.join(y, "posting").where(F.expr("a < b and ca <> cb") & within).select("a", "b").distinct())
        large = stored(left.where(F.col("members") > most), "near-large")
        forget(left)
        if depth == 3 or large.isEmpty():
            break
        # three bytes more, in 4 ways
        ways = [F.concat(*[F.expr(f"substring(wide, {1 + (way * 151 + part * 53 + depth * 17) % len(_ODD)}, 1)") for part in range(3)]) for way in range(4)]
        ways = F.array(*[F.struct(F.lit(k).alias("way"), w.alias("bytes")) for k, w in enumerate(ways)])
        postings = large.join(nodes, "node").select("node", "posting", F.explode(ways).alias("e")).select("node", F.xxhash64("posting", "e.way", "e.bytes").alias("posting"))
    forget(large, shared, met, sets, nodes, *tried)
    classes = lows.join(reached, "node", "left").select("print", F.coalesce("component", "node").alias("group"))
    return prints.join(stored(classes, "near-classes"), "print").select("row", "doc_id", "group")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of every group: that of the smallest doc_id (null last)."""
    row = fresh(docs, "_near_row")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "near-docs")
    found = groups(keyed.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, similarity)
    found = stored(found, "near-groups")
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    others = stored(found.join(best, "group").where("row <> best.row").select(F.col("row").alias("other")), "near-others")
    forget(found)
    return without(keyed, row, others).drop(row)
