"""Language identification by unigram pieces, summed over all segmentations.

A word is a maximal run of Unicode letters and marks, in lower case, with one
space before it. Its probability in a language is the sum, over every way to cut
its bytes into pieces of a fixed public vocabulary, of the product of the
pieces' probabilities there (forward algorithm). Pieces never reach over a
space, so a text's sum over all segmentations is the product over its words,
and each distinct word of a batch is summed once. Piece probabilities come from
expectation maximisation (forward-backward counts) on about ``sample`` labelled
documents of each language, whole texts, chosen by a hash of doc_id; words and
expected counts are gathered by Spark, and the driver keeps one number for each
language and piece. A share ``mix`` of the probability is
spread evenly over all pieces. Runs of over ``LONGEST`` bytes are cut every
``LONGEST`` bytes before segmentation, whatever the size of the text.

The vocabulary's pieces that hold lower-case letters or bytes from 128 on, after
at most one space, are used, with all 256 single bytes, so every word has a
segmentation.

Edge cases: a null text, one without a letter, and every text when no labelled
text has a word, get ``und`` and score 0; null doc_ids are scored like any
other row and never learnt from; repeated rows are scored each; languages with
equal sums are taken in the order of their names; the empty string is a
language like another; further columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _TABLE, chunks, powers, stored

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONGEST = 60
SCALE = 12.0  # bits a byte that keep sums of up to LONGEST bytes inside a double
PART = 1 << 20  # bytes of text in numpy arrays at a time


def letters(text):
    """The words of a text column in lower case, one space before each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}]+", " "))


def pieces(path: str | None = None) -> list[bytes]:
    """The usable pieces of the vocabulary file, in its order."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as lines:
        every = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    fit = lambda p: all(97 <= b <= 122 or b >= 128 for b in p.removeprefix(b" ")) and 0 < len(p) <= LONGEST
    return [p for p in every if len(p) == 1 or fit(p)]


class Vocabulary:
    """Piece numbers by hash and length."""

    def __init__(self, every: list[bytes]):
        every = list(dict.fromkeys([bytes([b]) for b in range(256)] + every))
        self.size = len(every)
        self.lengths = sorted({len(p) for p in every})
        self.tables = {}
        for n in self.lengths:
            ids = [i for i, p in enumerate(every) if len(p) == n]
            data = np.frombuffer(b"".join(every[i] for i in ids), np.uint8).reshape(-1, n)
            keys = (_TABLE[data] * powers(n)[0][:n]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(keys)
            self.tables[n] = keys[order], np.array(ids, np.int32)[order]
        self.bytes = np.array([len(p) for p in every])


class Distinct:
    """The distinct words of some texts (longest first), and of every word in
    turn its number and its text."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts) + b" ", np.uint8)
        gap = np.flatnonzero(data == 32)
        start, end = gap[:-1], gap[1:]
        some = end > start + 1
        start, end = start[some], end[some]
        if len(start) and (end - start).max() > LONGEST:  # cut long runs
            n = -(-(end - start) // LONGEST)
            first = np.repeat(start, n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            end = np.minimum(np.repeat(end, n), first + (at + 1) * LONGEST)
            start = first + at * LONGEST
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
        key = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
        offset = np.cumsum([0] + [len(t) for t in texts])
        self.doc = np.searchsorted(offset, start, side="right") - 1
        _, at, self.word = np.unique(key, return_index=True, return_inverse=True)
        length = (end - start)[at]
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word = place[self.word]
        self.start, self.length = start[at][order], length[order]
        self.data, self.total, self.down = data, total, down

    def found(self, vocabulary: Vocabulary):
        """For every end in the words, from short to long: (t, n, words with that
        end as a slice length, piece numbers; -1 for none)."""
        shorter = -self.length
        for t in range(1, int(self.length[0]) + 1 if len(self.length) else 1):
            k = int(np.searchsorted(shorter, -t, side="right"))
            for n in vocabulary.lengths:
                if n > t:
                    break
                a = self.start[:k] + (t - n)
                key = (self.total[a + n] - self.total[a]) * self.down[a]
                keys, ids = vocabulary.tables[n]
                at = np.searchsorted(keys, key)
                at[at == len(keys)] = 0
                yield t, n, k, np.where(keys[at] == key, ids[at], -1)


def forward(words: Distinct, found, scaled: np.ndarray) -> np.ndarray:
    """alpha[t]: scaled sums over all segmentations of the first t bytes.
    ``scaled``: probabilities times 2**(SCALE * bytes), pieces x languages, with
    a last row of zeros for no piece."""
    longest = int(words.length[0]) if len(words.length) else 0
    alpha = np.zeros((longest + 1, len(words.length), scaled.shape[1]))
    alpha[0] = 1
    for t, n, k, ids in found:
        alpha[t, :k] += alpha[t - n, :k] * scaled[ids]
    return alpha


def sums(words: Distinct, vocabulary: Vocabulary, scaled: np.ndarray) -> np.ndarray:
    """Natural logarithm of every word's sum, words x languages."""
    alpha = forward(words, words.found(vocabulary), scaled)
    whole = alpha[words.length, np.arange(len(words.length))]
    return np.log(whole) - (SCALE * np.log(2)) * words.length[:, None]


def expected(words: Distinct, count: np.ndarray, vocabulary: Vocabulary, scaled: np.ndarray) -> np.ndarray:
    """Expected uses of every piece, by forward-backward; ``count``: words x languages."""
    found = list(words.found(vocabulary))
    alpha = forward(words, found, scaled)
    rows = np.arange(len(words.length))
    beta = np.zeros_like(alpha)
    beta[words.length, rows] = count / alpha[words.length, rows]
    uses = np.zeros((vocabulary.size + 1, scaled.shape[1]))
    for t, n, k, ids in reversed(found):
        step = beta[t, :k] * scaled[ids]
        np.add.at(uses, ids, alpha[t - n, :k] * step)
        beta[t - n, :k] += step
    return uses[:-1]


class Model:
    """Languages, vocabulary, and scaled piece probabilities."""

    def __init__(self, langs: list[str], vocabulary: Vocabulary, uses: np.ndarray, mix: float):
        self.langs, self.vocabulary = langs, vocabulary
        share = (1 - mix) * uses / uses.sum(axis=0) + mix / vocabulary.size
        self.scaled = np.vstack([share * 2.0 ** (SCALE * vocabulary.bytes)[:, None], np.zeros((1, len(langs)))])

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every text in every language, and its word count."""
        words = Distinct(texts)
        each = sums(words, self.vocabulary, self.scaled)
        total = np.stack([np.bincount(words.doc, weights=each[words.word, k], minlength=len(texts)) for k in range(len(self.langs))], axis=1)
        return total, np.bincount(words.doc, minlength=len(texts))


def training_words(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, word, n) over about ``sample`` documents of each language: those
    whose hash falls in the first ``sample / documents`` of its range, all of
    them where there are no more than ``sample``."""
    known = docs.where("lang is not null and doc_id is not null and text is not null").select("lang", "text", F.xxhash64("doc_id").alias("h"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))]) if sizes else F.create_map()
    place = F.pmod(F.col("h"), F.lit(1 << 40)) / float(1 << 40)
    texts = known.where(place < F.try_element_at(share, F.col("lang"))) if sizes else known.where("false")
    word = F.explode(F.array_remove(F.split(letters(F.col("text")), " "), "")).alias("word")
    return texts.select("lang", word).groupBy("lang", "word").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, sample: int = 1000, rounds: int = 4, mix: float = 0.001, vocabulary: str | None = None) -> Model | None:
    """Expectation maximisation over (doc_id, lang, text); None without a word."""
    spark = docs.sparkSession
    table = stored(training_words(docs, sample), "langid-words")
    langs = sorted((r["lang"] for r in table.select("lang").distinct().collect()), key=lambda x: x.encode())
    if not langs:
        return None
    known = Vocabulary(pieces(vocabulary))
    number = {x: i for i, x in enumerate(langs)}
    # start: shorter pieces are likelier, alike in all languages
    model = Model(langs, known, np.repeat(2.0 ** -known.bytes[:, None].astype(float), len(langs), axis=1), mix)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def count(batches):
            uses = np.zeros((shared.value.vocabulary.size, len(langs)))
            for batch, texts in chunks(batches, column="word", most=PART // 4):
                words = Distinct([b" " + t for t in texts])
                n = np.zeros((len(words.length), len(langs)))
                lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
                np.add.at(n, (words.word, lang[words.doc]), np.array(batch.column("n").to_pylist(), float)[words.doc])
                uses += expected(words, n, shared.value.vocabulary, shared.value.scaled)
            piece, lang = np.nonzero(uses)
            yield pa.record_batch([pa.array(piece), pa.array(lang), pa.array(uses[piece, lang])], ["piece", "lang", "uses"])

        # expected counts as whole millionths, so that their sum has no order
        whole = table.mapInArrow(count, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum(F.round(F.col("uses") * 1e6).cast("long")).alias("uses")).toPandas()
        uses = np.zeros((known.size, len(langs)))
        uses[whole["piece"].to_numpy(), whole["lang"].to_numpy()] = whole["uses"].to_numpy() / 1e6
        model = Model(langs, known, uses, mix)
        shared.unpersist()
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score (posterior of lang_pred, languages equally
    likely before) of every whole text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("has"), letters(F.col("text")).alias("text"))
    if model is None:
        return base.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = np.array([*shared.value.langs, "und"], object)
        for batch, texts in chunks(batches, most=PART):
            total, count = shared.value.scores(texts)
            best = total.argmax(axis=1)
            score = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
            has = np.array(batch.column("has").to_pylist(), bool) & (count > 0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(names[np.where(has, best, len(names) - 1)], pa.string()), pa.array(np.where(has, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return base.mapInArrow(run, "doc_id long, lang_pred string, score double")
