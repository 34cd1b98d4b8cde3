"""Toxicity by a linear classifier on character n-grams that are scaled by
naive Bayes log-count ratios (NB-SVM with a logistic loss).

Features are the distinct character n-grams (3 to 6 characters of the
lower-cased text, a space standing for every run of other characters, so word
starts and ends count). The log-count ratio of an n-gram compares in how large
a share of toxic and of other documents it occurs. Only n-grams whose ratio is
large and that occur in several documents become features: a text of any
length has few of them by chance, so long texts are not marked for their
length. The classifier is fitted on a bounded sample of labelled documents
(``sample`` of each class, in the order of a hash of doc_id); scoring takes
whole texts of all documents.

Edge cases: null and empty texts, and texts without letters, get the score of
a text without features; without labels of both classes every score is the
share of toxic labels (0 if there are none); repeated label rows count once
(the largest label wins); further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks

ORDERS = (3, 4, 5, 6)
PART = 256 << 10  # bytes of text in numpy arrays at a time
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x100000001B3)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _squeezed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case with one space for everything between them, and
    where each text begins; texts are kept apart by six spaces."""
    data = LOWER[np.frombuffer(b" " + b" \x00\x00\x00\x00\x00\x00 ".join(texts) + b" \x00\x00\x00\x00\x00\x00", np.uint8)]
    begin = np.cumsum([0] + [len(t) + 8 for t in texts])
    letter = _LETTER[data]
    gap = data == 0
    keep = letter | gap
    keep[1:] |= letter[:-1]
    place = np.cumsum(keep) - keep
    return np.where(letter, data, np.where(gap, 0, 32))[keep].astype(np.uint8), place[begin[:-1]]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all n-grams (every order in turn), and the text of each."""
    data, begin = _squeezed(texts)
    owner = np.searchsorted(begin, np.arange(len(data)), side="right") - 1
    code = _MIX[data]
    keys, docs = [], []
    h = code.copy()
    inside = data != 0
    ok = inside.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            break
        h = (h[:-1] * _STEP) ^ code[n - 1 :]
        h ^= h >> np.uint64(29)
        ok = ok[:-1] & inside[n - 1 :]
        if n in ORDERS:
            keys.append((h * np.uint64(2 * n + 1))[ok]), docs.append(owner[: len(ok)][ok])
    return (np.concatenate(keys), np.concatenate(docs)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Up to ``sample`` labelled documents of each class: text, toxic."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("toxic").alias("_toxic"))
    order = F.xxhash64("_labelled")
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("_toxic") == value).orderBy(order, "_labelled").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    text = docs.select(F.col("doc_id").alias("_id"), F.col("text"))
    return text.join(chosen, F.col("_id") == F.col("_labelled")).select("text", F.col("_toxic").cast("int").alias("toxic"))


class Model:
    """Feature keys (sorted), their weights, and the bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.near = np.zeros(1 << 20, bool)  # whether any feature has these leading bits
        self.near[(keys >> np.uint64(44)).astype(np.int64)] = True

    def found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs."""
        keys, docs = grams(texts)
        maybe = self.near[(keys >> np.uint64(44)).astype(np.int64)]
        keys, docs = keys[maybe], docs[maybe]
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(0, bool)
        pair = np.unique(docs[hit] * max(1, len(self.keys)) + at[hit])
        return pair // max(1, len(self.keys)), pair % max(1, len(self.keys))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        docs, feature = self.found(texts)
        z = self.bias + np.bincount(docs, weights=self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(train: DataFrame, most_features: int = 20_000, least_docs: int = 3, least_ratio: float = 2.0, l2: float = 1e-3, steps: int = 300) -> Model:
    """Fit on rows (text, toxic); the sample must be bounded by the caller.

    Document counts of n-grams are gathered by Spark, the features' rows
    (a bounded sample, a bounded number of features) by the driver.
    """
    spark = train.sparkSession

    def count(batches):
        for batch, texts in chunks(batches, most=PART):
            keys, docs = grams(texts)
            toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
            by = np.lexsort((docs, keys))
            keys, docs = keys[by], docs[by]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
            keys, label = keys[new], toxic[docs[new]]
            head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            t = np.add.reduceat(label, head) if len(head) else head
            n = np.diff(np.append(head, len(keys)))
            yield pa.record_batch([pa.array(keys[head].view(np.int64)), pa.array(t), pa.array(n - t)], ["gram", "t", "c"])

    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    none = np.zeros(0, np.uint64)
    if not toxic or not clean:
        share = 0.0 if not toxic else 1.0
        return Model(none, np.zeros(0), 40.0 if share else -40.0)
    counts = train.mapInArrow(count, "gram long, t long, c long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    ratio = F.log((F.col("t") + 1) / (toxic + 2)) - F.log((F.col("c") + 1) / (clean + 2))
    strength = F.abs(ratio) * F.sqrt(F.col("t") + F.col("c"))
    chosen = counts.where((F.col("t") + F.col("c") >= least_docs) & (F.abs(ratio) >= least_ratio)).orderBy(strength.desc(), "gram").limit(most_features).select("gram", ratio.alias("r")).toPandas()
    keys = chosen["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, r = keys[order], chosen["r"].to_numpy(float)[order]
    shell = spark.sparkContext.broadcast(Model(keys, r, 0.0))

    def rows(batches):
        for batch, texts in chunks(batches, most=PART):
            docs, feature = shell.value.found(texts)
            cut = np.searchsorted(docs, np.arange(len(texts) + 1))
            yield pa.record_batch([batch.column("toxic").cast(pa.int32()), pa.array([feature[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:])], pa.list_(pa.int32()))], ["toxic", "features"])

    data = train.mapInArrow(rows, "toxic int, features array<int>").toPandas()
    y = data["toxic"].to_numpy(float)
    size = data["features"].map(len).to_numpy(np.int64)
    col = np.concatenate([np.asarray(x, np.int64) for x in data["features"]]) if size.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(y)), size)
    value = r[col]
    weight = np.where(y > 0, len(y) / (2 * toxic), len(y) / (2 * clean))
    u, bias = np.zeros(len(keys)), 0.0
    m = [np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)]
    for step in range(1, steps + 1):  # Adam on the mean logistic loss
        z = bias + np.bincount(row, weights=value * u[col], minlength=len(y))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.append(np.bincount(col, weights=value * g[row], minlength=len(keys)) + l2 * u / len(keys), g.sum())
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.999 * m[1] + 0.001 * grad**2
        move = 0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)
        u, bias = u - move[:-1], bias - move[-1]
    return Model(keys, u * r, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and toxicity score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in chunks(batches, most=PART):
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(shared.value.scores(texts))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; a row stays or
    goes on its own text, and all columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in chunks(batches, most=PART):
            yield batch.filter(pa.array(shared.value.scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
