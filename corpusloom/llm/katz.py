"""Katz backoff language model: Good-Turing discounts and exact backoff mass.

Tokens are lower-cased (A-Z) words and one end per text, after ``order - 1``
start symbols. An n-gram is known by a 64-bit hash that is built token by
token, so the hash of its context is the hash one token before.

The documents are dealt to blocks of a few MB. Every block sends its distinct
n-grams of each order with their counts to key ranges (``groupBy`` on order
and range), where the counts of all blocks are added: an n-gram, however
frequent, moves once a block. The answers go back to the blocks, in the order
of what was sent. Sorted keys move as packed differences, which halves the
volume. Two tables, partitioned by key range, make up the model:

* ``counts``: the training counts of the n-grams of every order;
* ``contexts``: of every context its denominator and log10 backoff weight: the
  mass that its discounts free, divided by the lower-order mass of the words
  not seen after it, so that the probabilities after it sum to one exactly.

A token is evaluated recursively: its unigram (the unknown class if never
seen), then for each higher order the discounted n-gram if that was seen, else
the backoff weight of its context (one if unseen) times what the order below
gives. Counts of 1 to ``K`` are discounted by Good-Turing; where the counts of
counts give no usable discount (too few of them), half a count is taken off.
Larger counts stay whole, as Katz has them. A context without a count of
``K`` or less would free nothing; its denominator is one more than its count,
so some mass is left to back off with (likewise the unknown class).

Edge cases: null and empty texts are a single end token; with no training
documents every token is unknown with probability one; every row has a result
row of its own, equal doc_ids included (fully equal rows share a block); an empty table gives an empty result;
further columns are ignored. Hashes aren't verified: among 10**9 distinct
n-grams the chance that any two share one is 3 %.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, fresh, stored

K = 5
ORDER = 2
BLOCK_BYTES = 5 << 20  # text that a block has, about
RANGE_KEYS = 2_000_000  # n-grams that the blocks send to a key range, about
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
SENT = "order int, range int, block long, keys binary, counts binary, values binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of the texts' tokens in turn, starts included: the hash of the k-gram
    that ends there (one array for each k), the text, and whether it is a
    start."""
    words = Words(texts)
    pad = max(order - 1, 1)
    size = words.count + pad + 1
    stop = np.cumsum(size)
    token = np.empty(int(stop[-1]) if len(size) else 0, np.uint64)
    start = np.zeros(len(token), bool)
    for k in range(pad):
        start[stop - size + k] = True
    inner = ~start
    inner[stop - 1] = False
    token[start], token[stop - 1], token[inner] = START, END, _mix(words.key)
    found = [token]
    for k in range(2, order + 1):
        before = np.concatenate((np.zeros(1, np.uint64), found[-1][:-1]))
        found.append(_mix(before * np.uint64(0x9E3779B97F4A7C15) + token + np.uint64(k)))
    return found, np.repeat(np.arange(len(texts)), size), start


def discounts(counts: dict[int, int], k: int = K) -> list[float]:
    """What is left of counts 1 to k (index 0 is count 1)."""
    n = [0, *(counts.get(r, 0) for r in range(1, k + 2))]
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 0.0
    out = []
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail != 1 else 0.0
        out.append(d if 0 < d < 1 else 1 - 0.5 / r)
    return out


def left(c: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts after the discount."""
    rate = np.append(np.array([1.0, *d]), 1.0)
    return c * rate[np.minimum(c, len(d) + 1)]


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys: their differences, byte by byte, compressed."""
    step = np.diff(keys, prepend=np.zeros(1, np.uint64))
    return zstandard.compress(step.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def squeezed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def opened(blob: bytes, dtype, width: int = 1) -> np.ndarray:
    values = np.frombuffer(zstandard.decompress(blob), dtype)
    return values.reshape(-1, width) if width > 1 else values


class Model:
    """The tables ``counts`` (order, range, keys, counts) and ``contexts``
    (order of the context, range, keys, values: denominator and log10 weight),
    and the few numbers that all tasks need."""

    def __init__(self, counts: DataFrame, ranges: int, order: int, tokens: int, types: int, discount: list[list[float]], freed: float):
        self.counts, self.contexts = counts, None
        self.ranges, self.order, self.tokens, self.types, self.discount = ranges, order, tokens, types, discount
        self.total = max(tokens if freed > 0 else tokens + 1, 1)
        self.unknown = freed / self.total if freed > 0 else 1 / self.total

    def numbers(self):
        return self.ranges, self.order, self.tokens, self.types, self.discount, self.total, self.unknown


def blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (learn, text, ...) with the block of every row, by a hash of
    its columns, and the bytes of all texts."""
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    number = max(1, -(-total // BLOCK_BYTES))
    hashed = [f"`{f.name}`" for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    return docs.withColumn("_block", F.pmod(F.xxhash64(*hashed), F.lit(number))), total


def _texts(frame: pd.DataFrame) -> list[bytes]:
    return [(t or "").encode() for t in frame["text"]]


def _distinct(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their weights added."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return keys[first], np.add.reduceat(weight[order], first) if len(first) else weight[:0]


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of every key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], place


def _rows(order: int, block: int, ranges: int, keys: np.ndarray, counts: np.ndarray | None = None, values: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of SENT, one for each key range."""
    bound = np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)
    cut = np.append(np.searchsorted(keys, bound), len(keys))
    some = lambda x, a, b: None if x is None else squeezed(x[a:b])
    for r, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        if a < b:
            yield order, r, block, packed(keys[a:b]), some(counts, a, b), some(values, a, b)


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["order", "range", "block", "keys", "counts", "values"])


def _places(start: np.ndarray, k: int, order: int) -> np.ndarray:
    """Where the k-grams end that a block needs: at every token, and, if
    contexts have k tokens, at the last start."""
    if k == order:
        return np.flatnonzero(~start)
    return np.flatnonzero(~start | np.append(~start[1:], False))


def sent(docs: DataFrame, ranges: int, order: int) -> DataFrame:
    """The distinct n-grams of every block, with their counts in training
    documents (starts count nothing)."""

    def run(key, frame):
        learn = frame["learn"].to_numpy(bool)
        found, doc, start = grams(_texts(frame), order)
        weight = learn[doc].astype(np.int64) * ~start
        out = []
        for k in range(1, order + 1):
            at = _places(start, k, order)
            keys, n = _distinct(found[k - 1][at], weight[at])
            out += _rows(k, int(key[0]), ranges, keys, n.astype(np.uint32))
        return _frame(out)

    return docs.groupBy("_block").applyInPandas(run, SENT)


def _joined(frame: pd.DataFrame, column: str, dtype, width: int = 1) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a key range: how many keys each has, all keys, all values, and
    the order that sorts the keys."""
    keys = [unpacked(x) for x in frame["keys"]]
    every = np.concatenate(keys)
    return [len(x) for x in keys], every, np.concatenate([opened(x, dtype, width) for x in frame[column]]), np.argsort(every, kind="stable")


def count(docs: DataFrame, ranges: int, order: int) -> DataFrame:
    """The training counts of every key range (block -1), and the answer to
    every block: counts of what it sent, negative where another block answers
    for an n-gram."""

    def run(key, frame):
        frame = frame.sort_values("block", kind="stable")
        sizes, keys, n, by = _joined(frame, "counts", np.uint32)
        ordered = keys[by]
        new = np.ones(len(by), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        head = np.flatnonzero(new)
        total = np.add.reduceat(n[by].astype(np.int64), head)
        # the first block with a training document that has it answers for it
        rank = np.where(n[by] > 0, np.arange(len(by)), len(by))
        owner = np.minimum.reduceat(rank, head)
        group = np.cumsum(new) - 1
        answer = np.empty(len(by), np.int64)
        answer[by] = np.where(owner[group] == np.arange(len(by)), 1, -1) * total[group]
        known = total > 0
        order, place = int(key[0]), int(key[1])
        out = [(order, place, -1, packed(ordered[head][known]), squeezed(total[known]), None)]
        cut = np.cumsum(sizes)[:-1]
        out += [(order, place, int(b), None, squeezed(a), None) for b, a in zip(frame["block"], np.split(answer, cut))]
        return _frame(out)

    return sent(docs, ranges, order).groupBy("order", "range").applyInPandas(run, SENT)


def _spectrum(counts: DataFrame) -> dict[int, tuple[int, int, dict[int, int]]]:
    """By order: tokens, types, counts of the counts up to K + 1."""
    names = ["tokens", "types", *[f"n{r}" for r in range(1, K + 2)]]

    def run(batches):
        for batch in batches:
            out = []
            for order, blob in zip(batch["order"], batch["counts"]):
                c = opened(blob, np.int64)
                few = np.bincount(c[c <= K + 1], minlength=K + 2)
                out.append((int(order), int(c.sum()), len(c), *few[1:].tolist()))
            yield pd.DataFrame(out, columns=["order", *names])

    table = counts.select("order", "counts").mapInPandas(run, ", ".join(["order int", *[f"{n} long" for n in names]]))
    rows = table.groupBy("order").agg(*[F.sum(n).alias(n) for n in names]).collect()
    return {r["order"]: (r["tokens"], r["types"], {k: r[f"n{k}"] for k in range(1, K + 2)}) for r in rows}


class Told:
    """What a block was told: by order the counts of its n-grams, and of its
    contexts the denominators and weights, each in the order of its keys."""

    def __init__(self, frame: pd.DataFrame):
        self.frame = frame.sort_values("range", kind="stable")

    def of(self, order: int, column: str, dtype, width: int = 1) -> np.ndarray:
        some = self.frame[(self.frame["order"] == order) & self.frame[column].notna()]
        if not len(some):
            return np.zeros((0, width) if width > 1 else 0, dtype)
        return np.concatenate([opened(x, dtype, width) for x in some[column]])

    def counts(self, order: int) -> np.ndarray:
        return self.of(order, "counts", np.int64)

    def values(self, order: int) -> np.ndarray:
        return self.of(order, "values", np.float64, 2)


def _masses(docs: DataFrame, told: DataFrame, model: Model, k: int) -> DataFrame:
    """What the blocks know of the contexts of k-grams (all of theirs): their
    counts, what discounts free, and the lower-order probabilities of the words
    seen, each seen k-gram in one block only."""
    ranges, order, tokens, types, discount, total, _ = model.numbers()

    def run(key, docs, told):
        told = Told(told)
        found, doc, start = grams(_texts(docs), order)
        place = lambda j: _places(start, j, order)
        places = place(k)
        keys, among = _sorted(found[k - 1][places])
        first = np.empty(len(keys), np.int64)
        first[among[::-1]] = np.arange(len(among))[::-1]
        c = told.counts(k)
        own = np.flatnonzero(c > 0)
        at, c = places[first[own]], c[own]
        places = place(k - 1)
        below, among = _sorted(found[k - 2][places])
        cb = np.abs(told.counts(k - 1))[among[np.searchsorted(places, at)]]
        if k == 2:
            p = left(cb, discount[1]) / total
        else:
            further = place(k - 2)
            p = left(cb, discount[k - 1]) / told.values(k - 2)[_sorted(found[k - 3][further])[1][np.searchsorted(further, at - 1)], 0]
        context = among[np.searchsorted(places, at - 1)]
        sums = np.zeros((len(below), 3))
        for j, x in enumerate((c, c - left(c, discount[k]), p)):
            sums[:, j] = np.bincount(context, weights=x, minlength=len(below))
        return _frame(_rows(k - 1, int(key[0]), ranges, below, None, sums))

    return docs.groupBy("_block").cogroup(told.groupBy("block")).applyInPandas(run, SENT)


def _weighed(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Denominators and log10 backoff weights of the contexts of a key range
    (block -1; those of unseen ones are zero), and the answer to every block."""
    frame = frame.sort_values("block", kind="stable")
    sizes, keys, sums, by = _joined(frame, "values", np.float64, 3)
    ordered = keys[by]
    new = np.ones(len(by), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    head = np.flatnonzero(new)
    c, freed, seen = np.add.reduceat(sums[by], head, axis=0).T
    none = freed <= 0
    total, freed = c + none, np.where(none, 1.0, freed)
    values = np.stack([total, np.log10(freed / total) - np.log10(np.maximum(1 - seen, 1e-300))], 1)
    values[c == 0] = 0
    back = np.empty((len(by), 2))
    back[by] = values[np.cumsum(new) - 1]
    order, place, known = int(key[0]), int(key[1]), c > 0
    out = [(order, place, -1, packed(ordered[head][known]), None, squeezed(values[known]))]
    out += [(order, place, int(b), None, None, squeezed(v)) for b, v in zip(frame["block"], np.split(back, np.cumsum(sizes)[:-1]))]
    return _frame(out)


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """Model of the documents (text, learn) whose ``learn`` is true (all
    without that column); ``order`` 2 or more is the longest n-gram."""
    if "learn" not in docs.columns:
        docs = docs.withColumn("learn", F.lit(True))
    table, size = blocks(docs.select("learn", "text").where("learn"))
    return _fit(table, size, order)[0]


def _fit(docs: DataFrame, size: int, order: int) -> tuple[Model, DataFrame]:
    """The model and what the blocks were told about their n-grams."""
    docs = docs.select("_block", "learn", "text")
    ranges = max(32, size // 6 * (order - 1) // RANGE_KEYS)
    counted = stored(count(docs, ranges, order), "lm-counts")
    counts, told = counted.where("block < 0"), counted.where("block >= 0")
    spectrum = _spectrum(counts)
    discount = [[], *[discounts(spectrum[k][2]) if k in spectrum else [0.5] * K for k in range(1, order + 1)]]
    tokens, types, few = spectrum.get(1, (0, 0, {}))
    freed = sum(n * r * (1 - discount[1][r - 1]) for r, n in few.items() if r <= K)
    model = Model(counts, ranges, order, tokens, types, discount, freed)
    for k in range(2, order + 1):
        weighed = stored(_masses(docs, told, model, k).groupBy("order", "range").applyInPandas(_weighed, SENT), "lm-contexts")
        contexts = weighed.where("block < 0")
        model.contexts = contexts if model.contexts is None else model.contexts.unionByName(contexts)
        told = told.unionByName(weighed.where("block >= 0"))
    return model, told


def lookup(docs: DataFrame, model: Model) -> DataFrame:
    """What blocks of any documents are told from the model's tables."""

    def found(wanted, keys, values):
        at = np.searchsorted(keys, wanted)
        there = at < len(keys)
        there[there] = keys[at[there]] == wanted[there]
        return squeezed(np.concatenate((values, np.zeros_like(values[:1]) if len(values) else np.zeros((1, *values.shape[1:]), values.dtype)))[np.where(there, at, len(keys))])

    def run(key, asked, table):
        order, place = int(key[0]), int(key[1])
        parts = []
        for column, dtype, width in (("counts", np.int64, 1), ("values", np.float64, 2)):
            some = table[table[column].notna()]
            keys = np.concatenate([np.zeros(0, np.uint64), *[unpacked(x) for x in some["keys"]]])
            values = np.concatenate([np.zeros((0, width) if width > 1 else 0, dtype), *[opened(x, dtype, width) for x in some[column]]])
            parts.append((keys, values))
        out = []
        for block, blob in zip(asked["block"], asked["keys"]):
            wanted = unpacked(blob)
            out.append((order, place, int(block), None, *(found(wanted, *p) for p in parts)))
        return _frame(out)

    asked = sent(docs, model.ranges, model.order)
    return asked.groupBy("order", "range").cogroup(model.counts.unionByName(model.contexts).groupBy("order", "range")).applyInPandas(run, SENT)


ADDED = ("n_tokens", "n_known", "base_score", "score")


def _renamed(docs: DataFrame) -> DataFrame:
    """``docs`` with other names for columns that clash with those made here."""
    for name in ("_block", "block", *ADDED):
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, fresh(docs, f"{name}_given"))
    return docs


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` but for ``text``, and n_tokens, n_known,
    base_score, score of every row; columns of ``docs`` with these names get
    ``_given`` at their end."""
    docs = _renamed(docs)
    columns = [c for c in docs.columns if c != "text"]
    table, _ = blocks(docs if "learn" in columns else docs.withColumn("learn", F.lit(False)))
    return _score(table, stored(lookup(table.select("_block", "learn", "text"), model), "lm-told"), model, columns)


def _score(docs: DataFrame, told: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    numbers = model.numbers()

    def run(key, docs, told):
        out = docs[columns].copy()
        for name, values in zip(ADDED, _evaluated(_texts(docs), Told(told), numbers)):
            out[name] = values
        return out

    types_of = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    layout = ", ".join([*[f"`{c}` {types_of[c]}" for c in columns], "n_tokens long, n_known long, base_score double, score double"])
    return docs.groupBy("_block").cogroup(told.groupBy("block")).applyInPandas(run, layout)


def _evaluated(texts: list[bytes], told: Told, numbers) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, add-one score, backoff score."""
    _, order, tokens, types, discount, total, unknown = numbers
    found, doc, start = grams(texts, order)
    at = np.flatnonzero(~start)
    per = lambda x: np.bincount(doc[at], weights=x, minlength=len(texts))
    score = base = n_known = np.zeros(0)
    context = None
    for k in range(1, order + 1):
        places = _places(start, k, order)
        among = _sorted(found[k - 1][places])[1]
        c = np.abs(told.counts(k))[among[~start[places]]]
        if k == 1:
            base, n_known = np.log10((c + 1) / (tokens + types + 1)), c > 0
            score = np.where(c > 0, np.log10(np.maximum(left(c, discount[1]), 1e-300) / total), math.log10(unknown))
        else:
            values = told.values(k - 1)[context]
            seen = np.log10(np.maximum(left(c, discount[k]), 1e-300)) - np.log10(np.maximum(values[:, 0], 1e-300))
            score = np.where(c > 0, seen, values[:, 1] + score)  # an unseen context has weight one, log10 zero
        context = among[np.searchsorted(places, at - 1)] if k < order else None
    return per(np.ones(len(at))).astype(np.int64), per(n_known).astype(np.int64), per(base), per(score)


def fit_and_score(docs: DataFrame, order: int = ORDER) -> tuple[Model, DataFrame]:
    """Fit on the rows whose ``learn`` is true and score all rows; what the
    blocks were told while counting is used again. Columns as in ``score``."""
    docs = _renamed(docs)
    table, size = blocks(docs)
    model, told = _fit(table, size, order)
    return model, _score(table, told, model, [c for c in docs.columns if c != "text"])
