"""Quality rules with risk-controlled thresholds. Native throughout.

A document's score is its highest measure, each divided by a fixed full value;
a stratum (language) rejects documents whose score reaches its cutoff. On
labelled documents (quality 1 good, 0 bad) the cutoffs of a fixed list are
tested in a fixed sequence from the strictest (rejecting least) down, and the
first failure ends the sequence. A cutoff passes when an exact binomial test
shows that it rejects at most ``risk`` of the good documents: with k of n good
ones rejected, the chance of k or fewer at that rate is at most ``delta``
divided by the number of strata. Of true failures only the first one reached
can pass wrongly, so the list needs no correction; with probability
``1 - delta`` no stratum loses more than ``risk`` of its good documents. Of the
certified cutoffs that one is taken that rejects the most of the bad beyond
what it rejects of the good. With 4 strata a stratum needs 217 good labels at
least; one with fewer has no cutoff and keeps all.

The counts of a document are taken in one pass over its text and written as a
table; labels are joined to that table only.

Edge cases: null and empty texts have zero counts; a null language is a
stratum of its own; a document with repeated label rows counts once, one with
labels that contradict each other not at all; labels with null quality are left
out; without labels only the base rule decides; null and repeated doc_ids are
judged each on their own text; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words_of

RISK, DELTA = 0.02, 0.05
#: Measure -> value that counts as a score of 1.
FULL = {"symbols": 0.3, "shouting": 0.95, "marks": 0.3, "repeats": 0.95, "copies": 0.95}
#: Cutoffs of the score, in the order of their tests.
CUTOFFS = [0.05 * k for k in range(20, 0, -1)]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    hashes = F.zip_with(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(words, 3, n), lambda ab, c: F.xxhash64(ab["a"], ab["b"], c))
    return F.when(F.size(words) < 4, F.array().cast("array<bigint>")).otherwise(hashes)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every whole text."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t\\x0B\\f\\r]"))
    removed = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    letters = F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    first = base.select(
        "doc_id",
        "lang",
        words_of(F.col("text")).alias("words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        removed("#*$%&|<>").alias("n_symbols"),
        removed("!?").alias("n_marks"),
        (F.length("text") - letters).cast("long").alias("n_upper"),
        lines.alias("lines"),
    )
    second = first.select(
        "doc_id",
        "lang",
        "word_chars",
        "n_symbols",
        "n_marks",
        "n_upper",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("h"),
    )
    some = F.size(F.array_distinct("h")) < F.size("h")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    third = second.withColumn("s", F.when(some, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(none)).drop("h")
    same = F.zip_with(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))), F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), lambda a, b: a["h"] == b["h"])
    fourth = third.withColumn("same", same)
    off = F.array(F.lit(False))
    found = F.zip_with("s", F.zip_with(F.concat(off, "same"), F.concat("same", off), lambda a, b: a | b), lambda x, d: F.when(d, x["i"]))
    fifth = fourth.withColumn("at", F.when(F.size("s") > 0, F.array_sort(F.array_compact(found))).otherwise(F.array().cast("array<int>"))).drop("s", "same")
    steps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return fifth.select("doc_id", "lang", "n_lines", "n_marks", "n_upper", *[c for c in COUNTS if c != "n_repeat_words"], F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"))


def measures() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols": share("n_symbols", "word_chars"), "shouting": share("n_upper", "word_chars"), "marks": share("n_marks", "word_chars"), "repeats": share("n_repeat_words", "n_words"), "copies": share("n_dup_lines", "n_lines")}


def score() -> Column:
    return F.greatest(*[value / F.lit(FULL[name]) for name, value in measures().items()])


def at_most(k: int, n: int, rate: float) -> float:
    """Exact chance of k or fewer among n at this rate."""
    if k >= n:
        return 1.0
    p = q = 0.0
    log_p, log_q = math.log(rate), math.log1p(-rate)
    for i in range(k, -1, -1):
        q = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q)
        p += q
        if i < n * rate and q < 1e-18 * p:
            break
    return min(1.0, p)


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[str | None, float]:
    """Certified cutoff of each stratum that has one. Gathers one number per
    stratum, label and cutoff."""
    # one label a document, or the trials of the test would not be independent
    own = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_doc"))
    known = own.agg(F.min("quality").alias("_quality"), F.max("quality").alias("_most")).where("_quality = _most").drop("_most")
    table = measured.join(known, F.col("doc_id") == F.col("_doc"))
    reached = F.size(F.filter(F.array(*[F.lit(c) for c in CUTOFFS]), lambda c: score() >= c))
    found = table.groupBy("lang", "_quality", reached.alias("reached")).count().collect()
    strata = sorted({r["lang"] for r in found}, key=str)
    out: dict[str | None, float] = {}
    for lang in strata:
        own = [r for r in found if r["lang"] == lang]
        total = [sum(r["count"] for r in own if r["_quality"] == q) for q in (0, 1)]
        if not total[0] or not total[1]:
            continue
        best = (0.0, 0.0)
        for i, cut in enumerate(CUTOFFS):
            hit = [sum(r["count"] for r in own if r["_quality"] == q and r["reached"] >= len(CUTOFFS) - i) for q in (0, 1)]
            if at_most(hit[1], total[1], risk) > delta / len(strata):
                break
            best = max(best, (hit[0] / total[0] - hit[1] / total[1], cut))
        if best[0] > 0:
            out[lang] = best[1]
    return out


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    measured = stored(counts(docs), "quality-counts")
    cutoffs = thresholds(measured, labels, risk, delta)
    rejected = F.lit(False)
    for lang, cut in cutoffs.items():
        rejected = rejected | (F.col("lang").eqNullSafe(F.lit(lang)) & (score() >= cut))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
