"""Nearest vectors by blocks against every pair."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import evaluation, nearest, retrieval

SCHEMA = "id long, v array<float>"


def made(n, seed=3):
    r = random.Random(seed)
    rows = [(i, [r.choice((-1.0, 0.5, 0.25, 1.0)) for _ in range(6)]) for i in range(n)]
    same = [(n + i, [1.0] * 6) for i in range(300)]  # one common vector
    odd = [(5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5002, [1.0, 2.0]), (5003, [float("nan")] * 6), (None, [1.0] * 6)]
    return rows + same + odd


def test_blocks_equal_every_pair(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ENTRY_BLOCK", 100)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 7)
    e = spark.createDataFrame(made(700), SCHEMA)
    q = e.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    for k in (1, 10):
        plain = retrieval.top(e.crossJoin(q).select("qid", "id", F.round(retrieval.dot("qv", "v"), 6).alias("score")), k, ["qid"])
        key = lambda df: sorted(map(str, df.select("qid", "rk", "id", "score").collect()))
        got = retrieval.dense_topk(q, e, k)
        assert key(got) == key(plain)


def test_pairs_are_neither_shuffled_nor_stored(spark):
    """The former plans joined all pairs in Spark and shuffled them."""
    e = spark.range(3000).select("id", F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(8)]).alias("v"))
    q = e.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    found = nearest.best_of_blocks(q, e, 60, 3000, 5, 6, 8)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert found.count() == 60 * 5


def test_buckets_decide_what_meets(spark):
    rows = [(i, [1.0, i / 100.0], [i % 2, i % 3]) for i in range(30)]
    e = spark.createDataFrame(rows, "id long, v array<double>, h array<long>")
    q = spark.createDataFrame([(0, [1.0, 0.0], [0, 7]), (1, [1.0, 0.0], [9, 9])], "qid long, qv array<double>, qh array<long>")
    got = {r["id"] for r in nearest.best_of_blocks(q, e, 2, 30, 50, 6, 2, 2).where("qid = 0").collect()}
    assert got == {i for i in range(30) if i % 2 == 0}
    assert nearest.best_of_blocks(q, e, 2, 30, 50, 6, 2, 2).where("qid = 1").count() == 0


def test_gold_is_counted_by_label(spark):
    entries = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)] + [(3, "a"), (30, None), (31, "c")], "id long, label string")
    queries = spark.createDataFrame([(0, "a"), (1, "b"), (3, "b"), (3, "a"), (30, None), (31, "c")], "qid long, label string")
    ranked = spark.createDataFrame([(q, i, i + 1) for q in (0, 1, 3, 30, 31) for i in range(10) if i != q], "qid long, id long, rk long")
    gold = entries.join(queries, "label").where("id <> qid").select("qid", "id")
    key = lambda df: sorted(map(str, df.collect()))
    right, total = evaluation.same_label(entries, queries, ranked)
    assert key(evaluation.ranking_metrics(ranked, right, total)) == key(evaluation.ranking_metrics(ranked, gold))
    text = queries.select("qid", F.lit("xx").alias("text")).distinct()
    assert key(evaluation.failure_report(ranked, right, text, total)) == key(evaluation.failure_report(ranked, gold, text))
    assert right.count() <= ranked.count()
