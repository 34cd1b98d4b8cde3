"""Metrics: ranking, sets, spans, failure reports, grid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K


def same_label(entries: DataFrame, queries: DataFrame, ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold of queries whose right entries are all others of their label: the
    right rows among ``ranked`` (qid, id), and qid, n_gold of every query that
    has any. They are counted by label; only queries with several labels, which
    may share entries, are paired. ``entries``: id, label; ``queries``: qid, label."""
    asked, given = queries.where("label is not null").distinct(), entries.where("label is not null").distinct()
    right = ranked.join(given, "id").join(asked, ["qid", "label"]).select("qid", "id").distinct()
    several = asked.groupBy("qid").agg(F.count("*").alias("c"), F.min("label").alias("label"))
    sizes = given.groupBy("label").agg(F.count("*").alias("n"))
    own = given.select(F.col("id").alias("qid"), "label", F.lit(1).alias("own"))
    one = several.where("c = 1").join(sizes, "label").join(own, ["qid", "label"], "left").select("qid", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n_gold"))
    pairs = asked.join(several.where("c > 1").select("qid"), "qid").join(given, "label").where("id <> qid")
    total = one.where("n_gold > 0").unionByName(pairs.groupBy("qid").agg(F.countDistinct("id").alias("n_gold")))
    return right.where("id <> qid"), total


def ranking_metrics(ranked: DataFrame, gold: DataFrame, total: DataFrame | None = None, ks=(1, 3, 5, 10), depth: int = 10) -> DataFrame:
    """Metric, value. ``ranked``: qid, id, rk; ``gold``: qid, id, of
    which those among ``ranked`` are enough if ``total`` (qid, n_gold) is given.
    Queries without a hit count as zero; two forms of NDCG are given, which
    differ in their ideal (what was retrieved, or what there is)."""
    want = gold.select("qid", "id").distinct()
    if total is None:
        total = want.groupBy("qid").agg(F.count("*").alias("n_gold"))
    hits = ranked.join(want, ["qid", "id"], "left_semi").where(F.col("rk") <= depth)
    per = hits.groupBy("qid").agg(F.min("rk").alias("first"), F.sum(1 / F.log2(F.col("rk") + 1.0)).alias("dcg"), *[F.count_if(F.col("rk") <= k).alias(f"h{k}") for k in ks])
    shown = ranked.where(F.col("rk") <= depth).groupBy("qid").agg(F.count("*").alias("shown"))
    all_ = total.join(per, "qid", "left").join(shown, "qid", "left")
    ideal = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    metrics: dict[str, Column] = {f"hit@{k}": (zero(f"h{k}") > 0).cast("double") for k in ks}
    metrics |= {f"recall@{k}": zero(f"h{k}") / F.col("n_gold") for k in ks}
    metrics["mrr"] = F.coalesce(1 / F.col("first"), F.lit(0.0))
    metrics["ndcg_gold"] = F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal(F.least(F.col("n_gold"), F.lit(depth)))
    metrics["ndcg_shown"] = F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal(F.least(F.col("n_gold"), F.coalesce(F.col("shown"), F.lit(1))))
    wide = all_.agg(*[F.round(F.avg(v), 6).alias(n) for n, v in metrics.items()])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in metrics])))


def set_scores(gold, pred) -> dict[str, Column]:
    """Precision, recall and F1 of two arrays as sets, in both conventions
    for empty sets (``_one``: two empty sets have precision and recall 1)."""
    g, p = F.array_distinct(T._col(gold)), F.array_distinct(T._col(pred))
    both = F.size(F.array_intersect(g, p))
    precision = F.when(F.size(p) == 0, 0.0).otherwise(both / F.size(p))
    recall = F.when(F.size(g) == 0, 0.0).otherwise(both / F.size(g))
    f1 = F.when((F.size(g) == 0) & (F.size(p) == 0), 1.0).when(both == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    none = (F.size(g) == 0) & (F.size(p) == 0)
    return {"precision": precision, "recall": recall, "f1": f1, "precision_one": F.when(none, 1.0).otherwise(precision), "recall_one": F.when(none, 1.0).otherwise(recall)}


def exact_match(gold, pred) -> Column:
    """Equal keyword sets."""
    return F.array_sort(F.array_distinct(T._col(gold))) == F.array_sort(F.array_distinct(T._col(pred)))


def span_f1(rows: DataFrame) -> DataFrame:
    """Micro span scores, tag accuracy, sequence exact match of (gold,
    pred) tag lists."""
    g, p = K.word_ends("gold"), K.word_ends("pred")
    base = rows.select("gold", "pred", g.alias("g"), p.alias("p"))
    tp = F.sum(F.size(F.array_intersect("g", "p")))
    same = F.sum(F.size(F.filter(F.zip_with("gold", "pred", lambda a, b: a == b), lambda x: x)))
    sums = base.agg(tp.alias("tp"), F.sum(F.size("p")).alias("np"), F.sum(F.size("g")).alias("ng"), same.alias("same"), F.sum(F.size("gold")).alias("n"), F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("exact"))
    precision, recall = F.col("tp") / F.col("np"), F.col("tp") / F.col("ng")
    values = {"precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall), "tag_accuracy": F.col("same") / F.col("n"), "exact": F.col("exact")}
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.round(v, 6).alias("value")) for n, v in values.items()])))


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """A9"""
    return rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def failure_report(ranked: DataFrame, gold: DataFrame, queries: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Bucket of query length x band of the first right rank: n.
    ``gold`` and ``total`` as in ``ranking_metrics``."""
    first = ranked.join(gold.select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy("qid").agg(F.min("rk").alias("first"))
    base = queries.join((gold if total is None else total).select("qid").distinct(), "qid", "left_semi").join(first, "qid", "left").withColumn("first", F.coalesce("first", F.lit(-1)))
    length = F.length("text")
    size = F.when(length <= 4, "<=4").when(length <= 8, "5-8").otherwise(">8")
    band = F.when(F.col("first") < 0, "not found").when(F.col("first") == 1, "1").when(F.col("first") <= 3, "2-3").when(F.col("first") <= 10, "4-10").otherwise("11+")
    return base.groupBy(size.alias("length_bucket"), band.alias("rank_band")).agg(F.count("*").alias("n"))


def grid_search(features: DataFrame, dense, field, fused) -> DataFrame:
    """hit@1 and MRR for every combination of weights in one job.
    ``features``: qid, id, dense, field, fused (scaled), relevant (0/1)."""
    from pyspark.sql import Window

    axis = lambda xs, n: F.explode(F.array(*[F.lit(float(x)) for x in xs])).alias(n)
    grid = features.select("*", axis(dense, "w1")).select("*", axis(field, "w2")).select("*", axis(fused, "w3"))
    score = F.round(F.col("w1") * F.col("dense") + F.col("w2") * F.col("field") + F.col("w3") * F.col("fused"), 9)
    order = Window.partitionBy("w1", "w2", "w3", "qid").orderBy(score.desc(), "id")
    ranked = grid.withColumn("rk", F.row_number().over(order)).where("relevant = 1").groupBy("w1", "w2", "w3", "qid").agg(F.min("rk").alias("first"))
    return ranked.groupBy("w1", "w2", "w3").agg(F.round(F.avg((F.col("first") == 1).cast("double")), 6).alias("hit1"), F.round(F.avg(1 / F.col("first")), 6).alias("mrr"))


def vocabulary(texts: DataFrame, column: str, least: int = 1, first_id: int = 2) -> DataFrame:
    """Characters by falling count, then by character; ids after pad and
    unknown. The characters of a script are a bounded set, so they are ranked
    in one window after the counting."""
    from pyspark.sql import Window

    counts = texts.select(F.explode(K.ngrams(column, 1)).alias("ch")).groupBy("ch").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.withColumn("vid", (F.row_number().over(Window.orderBy(F.col("n").desc(), "ch")) + (first_id - 1)).cast("long"))


def class_weights(rows: DataFrame, label: str, cap: float = 5.0) -> DataFrame:
    """Laplace-1 counts, total / (classes x count), divided by the
    largest, capped and scaled."""
    from pyspark.sql import Window

    whole = Window.partitionBy(F.lit(1))
    counts = rows.groupBy(F.col(label).alias("label")).agg((F.count("*") + 1).alias("c"))
    raw = counts.withColumn("w", F.sum("c").over(whole) / (F.count("*").over(whole) * F.col("c")))
    return raw.select("label", F.round(F.least(F.col("w") / F.max("w").over(whole), F.lit(cap)) / cap, 9).alias("weight"))


def model_compare(rows: DataFrame) -> DataFrame:
    """Per model the calls, mean latency, share of good answers and
    of valid ids. ``rows``: model, seconds, ok, valid, given."""
    return rows.groupBy("model").agg(F.count("*").alias("calls"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("ok_rate"), F.round(F.sum("valid") / F.greatest(F.sum("given"), F.lit(1)), 6).alias("valid_ratio"))


def mean_rates(df: DataFrame, conditions: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """The share of rows for which each condition holds (null: not)."""
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int").cast("double")), 6)
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[rate(c).alias(name) for name, c in conditions.items()])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """A10: how often each value of each column occurs, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("x")).groupBy("x.name", "x.value").agg(F.count("*").alias("n"))


def conditional_counts(df: DataFrame, conditions: dict[str, Column], by: list[str]) -> DataFrame:
    """Of each group its rows and those that meet each condition."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def array_coverage(df: DataFrame, items: str) -> DataFrame:
    """Rows with an array, and how many items these hold in all."""
    return df.where(F.col(items).isNotNull()).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.size(items)), F.lit(0)).alias("n_items"))


def rank_diagnosis(ranks: DataFrame, rank: str, cuts: tuple[int, ...] = (1, 5, 10, 50)) -> DataFrame:
    """How many targets stand at each cut or better; null or below 1 is
    not found."""
    found = F.col(rank) >= 1
    return ranks.agg(F.count("*").alias("n"), F.count_if(found).alias("found"), *[F.count_if(found & (F.col(rank) <= c)).alias(f"top_{c}") for c in cuts])


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties half. Rows are counted by score
    first; scores are then dealt by range, and what lies below a range is added
    up from one row a range, so no task holds all scores."""
    from ..plans.session import shared

    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    ranged = shared(counts.repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("c"))
    below = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.c"), F.lit(0)).alias("below"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("inside", inside).join(below, "part")
    won = F.sum(F.col("p") * (F.col("below") + F.col("inside") + F.col("n") / 2.0))
    return placed.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.round(won / (F.sum("p") * F.sum("n")), 6).alias("auc"))
