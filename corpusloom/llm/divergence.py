"""How far the sources of a language differ in their terms, term by term.

Terms are maximal runs of bytes in A-Z, a-z or from 128 on, only A-Z lower-cased
(the pattern ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``). A language keeps the terms
that at least ``least_docs`` of its documents have. With N the count of kept
terms in a group and V their number, ``p = 1 + floor(10**9 (n + 1) / (N + V))``
for a term that occurs n times there, and two groups differ by
``floor((p - q)**2 / q)`` in a term. All of it is whole-number arithmetic.

Heavy-light split: the terms of a language are dealt to shards of about
``shard_terms``. In a shard, terms that ``heavy`` of the sources or more have
fill dense tiles of counts (terms x sources), compared pair of sources by pair.
For the rest all pairs first get what a term gives that neither source has;
then every posting corrects its source's pairs (postings of equal source and
count at once), and the postings of a term correct each other. Both sums are
int64, so they add up exactly in any order, within a shard and over shards.

A task holds one shard of one language: its postings, and a few arrays of
sources x sources, which is the shape of the result too.

Edge cases: null text, lang and source are ''; a group without terms, and every
group of a language that keeps none, has count 0 everywhere; repeated rows are
documents of their own; a language with one source has no pairs; an empty table
gives no rows; further columns of any name are ignored. Texts of any length are
read in pieces that end between terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, LOWER, chunks, stored

BILLION = 10**9
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
BUFFER = 400_000  # rows that a task gathers before it adds equal ones up
TILE = 1 << 22  # numbers in a dense tile


# -- counting -------------------------------------------------------------------


def cut(text: bytes, most: int = CHUNK) -> list[bytes]:
    """Pieces of about ``most`` bytes that end between terms."""
    out, at = [], 0
    while len(text) - at > most:
        end = at + most
        while end < len(text) and _TERM[text[end]]:
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def terms(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Terms of all texts in order, and the text of each."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = _TERM[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    offset = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    letters = LOWER[data[inside]]
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offset), pa.py_buffer(letters)).cast(pa.string())
    place = np.cumsum([0] + [len(t) + 1 for t in texts])
    return words.dictionary_encode(), np.searchsorted(place, start, side="right") - 1


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: added up within each task as far as memory
    for ``BUFFER`` rows goes; equal rows may remain."""
    base = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    names = ["lang", "source", "term"]
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def tally(batch, texts, group):
        """Rows of some texts; ``group``: number of each text's (lang, source)."""
        words, doc = terms(texts)
        code = words.indices.to_numpy()
        size = max(1, len(words.dictionary))
        pair, n = np.unique(doc * size + code, return_counts=True)
        key = group[pair // size] * size + pair % size
        _, head, where = np.unique(key, return_index=True, return_inverse=True)
        total = np.zeros(len(head), np.int64)
        np.add.at(total, where, n)
        row = pa.array(pair[head] // size)
        docs_ = np.bincount(where, minlength=len(head))
        return pa.table([batch.column("lang").take(row), batch.column("source").take(row), words.dictionary.take(pa.array(pair[head] % size)), pa.array(total), pa.array(docs_)], schema=schema)

    def add(tables):
        out = pa.concat_tables(tables).group_by(names).aggregate([("n", "sum"), ("docs", "sum")])
        return out.select([*names, "n_sum", "docs_sum"]).rename_columns(schema.names)

    def long_text(row, text):
        """One document in pieces: every term counts for one document."""
        whole = None
        for piece in cut(text):
            part = tally(row, [piece], np.zeros(1, np.int64))
            whole = part if whole is None else add([whole, part])
        return whole.set_column(4, "docs", pa.array(np.ones(len(whole), np.int64)))

    def run(batches):
        held, rows = [], 0
        for batch, texts in chunks(batches):
            if len(texts) == 1 and len(texts[0]) > CHUNK:
                part = long_text(batch, texts[0])
            else:
                lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
                group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                part = tally(batch, texts, group)
            held.append(part)
            rows += len(part)
            if rows > BUFFER:
                held = [add(held)]
                rows = len(held[0])
                if rows > BUFFER // 2:
                    yield from held[0].to_batches(max_chunksize=10_000)
                    held, rows = [], 0
        if held:
            yield from add(held).to_batches(max_chunksize=10_000)

    return base.mapInArrow(run, "lang string, source string, term string, n long, docs long")


# -- whole-number arithmetic ------------------------------------------------------


def share(n: np.ndarray, total) -> np.ndarray:
    """``1 + floor(10**9 (n + 1) / total)`` by long division, three digits a
    step: exact for totals up to 9 * 10**15."""
    whole, rest = np.divmod(n + 1, total)
    for _ in range(3):
        rest = rest * 1000
        step = rest // total
        whole, rest = whole * 1000 + step, rest - step * total
    return whole + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    away = p - q
    return away * away // q


def dense(p: np.ndarray) -> np.ndarray:
    """Sum over terms of gap for every pair of sources; ``p``: terms x sources."""
    s = p.shape[1]
    out = np.zeros((s, s), np.int64)
    step = max(1, TILE // max(1, s))
    for at in range(0, len(p), step):
        tile = p[at : at + step]
        for a in range(s):
            out[a] += gap(tile[:, a, None], tile).sum(axis=0)
    return out


def sparse(rows: int, source: np.ndarray, n: np.ndarray, size: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for ``rows`` terms given by postings: ``size`` of each term in
    turn, with source and count of each posting; total: N + V of the sources."""
    s = len(total)
    none = share(np.zeros(s, np.int64), total)
    without = gap(none[:, None], none[None, :])
    out = without * rows
    # a posting against the sources that lack the term, equal ones at once
    kinds, times = np.unique(np.stack([source, n]), axis=1, return_counts=True)
    for a in range(s):
        own = kinds[0] == a
        if own.any():
            p = share(kinds[1][own], total[a])[:, None]
            out[a] += ((gap(p, none[None, :]) - without[a]) * times[own][:, None]).sum(axis=0)
            out[:, a] += ((gap(none[None, :], p) - without[:, a]) * times[own][:, None]).sum(axis=0)
    # postings of a term against each other
    p, first = share(n, total[source]), np.cumsum(size) - size
    for k in np.unique(size):
        if k < 2:
            continue
        begin = first[size == k]
        for at in range(0, len(begin), max(1, TILE // (4 * k * k))):
            pick = begin[at : at + max(1, TILE // (4 * k * k)), None] + np.arange(k)
            i, x = source[pick], p[pick]
            a, b = i[:, :, None], i[:, None, :]
            both = gap(x[:, :, None], x[:, None, :]) - gap(x[:, :, None], none[b]) - gap(none[a], x[:, None, :]) + without[a, b]
            np.add.at(out.reshape(-1), (a * s + b).reshape(-1), both.reshape(-1))
    return out


def shard_rows(kept: pa.Table, groups: pa.Table, heavy: float, top: int) -> pa.Table:
    """What one shard of a language gives: for each source the sums over the
    shard's terms against every source (in the order of ``sources``), and its
    ``top`` terms that it uses more than the language."""
    groups = groups.sort_by("source")
    sources = groups.column("source").combine_chunks()
    total = groups.column("total").to_numpy()
    lists = kept.column("posting").combine_chunks()
    size = pc.list_value_length(lists).to_numpy().astype(np.int64) if len(kept) else np.zeros(0, np.int64)
    flat = lists.flatten()
    source = pc.index_in(flat.field("source"), value_set=sources).to_numpy().astype(np.int64) if len(kept) else np.zeros(0, np.int64)
    n = flat.field("n").to_numpy() if len(kept) else np.zeros(0, np.int64)
    s, term = len(sources), np.repeat(np.arange(len(kept)), size)
    many = size >= max(2, heavy * s)
    tile = np.zeros((int(many.sum()), s), np.int64)
    row = np.cumsum(many) - 1
    tile[row[term[many[term]]], source[many[term]]] = n[many[term]]
    few = ~many[term]
    pairs = dense(share(tile, total[None, :])) + sparse(int((~many).sum()), source[few], n[few], size[~many], total)
    lang_n = np.bincount(term, minlength=len(kept)).astype(np.int64) * 0
    np.add.at(lang_n, term, n)
    lang_total = groups.column("lang_total")[0].as_py()
    p, q = share(n, total[source]), share(lang_n, np.int64(lang_total))[term]
    value = gap(p, q)
    more = np.flatnonzero(p > q)
    words = kept.column("term").combine_chunks()
    listed: list[list] = [[] for _ in range(s)]
    if len(more):
        names = pc.rank(words.cast(pa.binary()), sort_keys="ascending").to_numpy().astype(np.int64)
        more = more[np.lexsort((names[term[more]], -value[more], source[more]))]
        begin = np.searchsorted(source[more], np.arange(s + 1))
        for a in range(s):
            mine = more[begin[a] : begin[a + 1]][:top]
            listed[a] = [{"item": w, "value": int(v)} for w, v in zip(words.take(pa.array(term[mine])).to_pylist(), value[mine])]
    kind = pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())]))
    lang = groups.column("lang").combine_chunks()
    return pa.table([lang, sources, pa.array([sources.to_pylist()] * s, pa.list_(pa.string())), pa.array(list(pairs), pa.list_(pa.int64())), pa.array(listed, kind)], names=["lang", "source", "others", "sums", "terms"])


SHARD = "lang string, source string, others array<string>, sums array<bigint>, terms array<struct<item:string,value:bigint>>"


# -- the audit ---------------------------------------------------------------------


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, term and its posting: the sources that have it with their counts."""
    # dealt by term first: both groupings below then find their rows together
    rows = counted(docs).repartition("lang", "term")
    each = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("posting"))
    return whole.where(F.col("docs") >= least_docs).select("lang", "term", "posting")


def totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (N + V of the group), lang_total, of every group of ``docs``."""
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    each = kept.select("lang", F.explode("posting").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("N"))
    types = kept.groupBy("lang").agg(F.count("*").alias("V"))
    both = groups.join(each, ["lang", "source"], "left").join(types, "lang", "left").na.fill(0, ["N", "V"])
    lang = Window.partitionBy("lang")
    # a language that keeps no term divides by nothing: its totals are not used
    return both.select("lang", "source", F.greatest(F.col("N") + F.col("V"), F.lit(1)).alias("total"), F.greatest(F.sum("N").over(lang) + F.col("V"), F.lit(1)).alias("lang_total"))


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, heavy: float = 0.5, shard_terms: int = 4000) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    kept = stored(kept_terms(docs, least_docs), "audit-terms")
    groups = stored(totals(docs, kept), "audit-groups")
    shards = max(1, -(-kept.count() // shard_terms))
    left = kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("long"))
    right = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        return shard_rows(a, b, heavy, top) if len(b) else pa.table([[]] * 5, names=["lang", "source", "others", "sums", "terms"])

    parts = stored(left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard")).applyInArrow(work, SHARD), "audit-parts")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    number = F.row_number().over(order).alias("rank")
    pair = parts.select("lang", "source", F.explode(F.arrays_zip(F.col("others").alias("item"), F.col("sums").alias("value"))).alias("x")).where("x.item <> source")
    pair = pair.groupBy("lang", "source", F.col("x.item").alias("item")).agg(F.sum("x.value").alias("value"))
    term = parts.select("lang", "source", F.explode("terms").alias("x")).select("lang", "source", "x.item", "x.value")
    best = term.select("*", number).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pair.select("*", number), "pair").unionByName(columns(best, "term"))
