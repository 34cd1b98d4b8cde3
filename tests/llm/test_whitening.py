"""Whitening against numpy, and rows of every kind."""

import numpy as np
import pytest

from corpusloom.llm import queries, whitening


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s) ** 2).sum(axis=1), c, e[::-1], u[:, ::-1]


def same(got, ids, vectors, components=8):
    n, dev, c, e, u = brute(vectors)
    k = min(components, c.shape[1])
    want = c @ u[:, :k] / np.sqrt(e[:k])
    table = np.array([[r["whitened"] for r in sorted(got, key=lambda r: (r["vec_id"], r["component"])) if r["vec_id"] == i] for i in sorted(ids)])
    want = want[np.argsort(ids, kind="stable")]
    assert np.allclose(table, want * np.sign((table * want).sum(axis=0)), atol=1e-9)
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: int(d) for i, d in zip(ids, dev)}
    assert {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    for r in got:
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-10 and r["identity_error"] < 1e-9


def test_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    out = queries.QUERIES["op13_whitening"](spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    same(out.collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_rows_without_a_place(spark):
    rng = np.random.default_rng(1)
    good = [[float(a) for a in rng.normal(size=3).astype(np.float32)] for _ in range(40)]
    bad = [None, [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [0.0, float("inf"), 0.0], [0.0, 0.0, float("-inf")], [], [1.0, 2.0]]
    rows = [(i, v, "s") for i, v in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string")
    same(whitening.whiten(df).collect(), list(range(40)), good)


def test_repeats_and_null_ids(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [2.0, 1.5]), (3, [1.0, 0.25])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((i or 0, c) for i, _ in rows for c in (1, 2))
    w = np.array(sorted((r["component"], r["whitened"]) for r in got))
    assert abs((w[:4, 1] ** 2).mean() - 1) < 1e-9


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0], [1.0, 2.0]]])
def test_without_variance(spark, vectors):
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    assert len(got) == 2 * len(vectors) and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in got)


def test_rank_below_dimensions(spark):
    got = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(6)], "vec_id long, embedding array<double>")).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True), (3, True)}


def test_many_dimensions_take_several_aggregations(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST", 7)
    rng = np.random.default_rng(2)
    vectors = [[float(a) for a in rng.normal(size=6)] for _ in range(30)]
    same(whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), 4).collect(), list(range(30)), vectors, 4)


def test_wide_deviations(spark):
    rows = [(0, [-1e12, 0.0]), (1, [1e12, 1.0]), (2, [3e5, 0.5])]
    x = [[int(np.floor(1024 * a)) + 100000 for a in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    model = whitening.fit(*whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    got = whitening.project(whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0], model)[0].collect()
    assert {r["key"]: int(r["deviation"]) for r in got} == {i: sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(df).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], df.schema)).count() == 0
