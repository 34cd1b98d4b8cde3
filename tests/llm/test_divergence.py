"""The source audit against DuckDB, on made documents and on a table."""

import duckdb
import numpy as np
import pytest

from corpusloom.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string"
ROWS = [
    (1, "Red red apple, blue-green", "en", "a"),
    (2, "red APPLE blue Éclair", "en", "b"),
    (2, "red APPLE blue Éclair", "en", "b"),
    (3, "apple apple apple éclair red", "en", None),
    (None, "red éclair\x00blue9apple", "en", "c"),
    (5, None, "en", "silent"),
    (6, "", "", ""),
    (7, "un deux trois", "fr", "a"),
    (8, "un deux", "fr", "b"),
    (9, None, None, "x"),
    (10, "solo solo", "de", "only"),
    (11, "solo", "de", "only"),
    (12, "SOLO!", "de", "only"),
]


def rows_of(got):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got.collect())


def expected(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({queries.ORACLES['op11_divergence']})").fetchall())


@pytest.mark.parametrize("heavy", [0.0, 0.5, 2.0])
def test_made(spark, tmp_path, heavy):
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], SCHEMA)
    docs.write.parquet(f"{tmp_path}/d")
    got = rows_of(divergence.audit(docs, heavy=heavy, shard_terms=2))
    assert got == expected(f"{tmp_path}/d")
    assert {(s, i) for lang, s, part, i, *_ in got if lang == "fr" and part == "pair"} == {("a", "b"), ("b", "a")}
    assert all(v == 0 for lang, _, _, _, v, _ in got if lang == "fr")


def test_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/d")
    assert rows_of(queries.QUERIES["op11_divergence"](spark, sf)) == expected(f"{tmp_path}/d")
    assert rows_of(divergence.audit(docs, heavy=0.2, shard_terms=300)) == expected(f"{tmp_path}/d")


def test_ranks_stop_at_200(spark, tmp_path):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(260)]
    docs = spark.createDataFrame([(i, " ".join(words), "en", "a") for i in range(3)] + [(9, "wholly other words", "en", "b")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/d")
    got = rows_of(divergence.audit(docs, shard_terms=40))
    assert got == expected(f"{tmp_path}/d")
    assert max(r[-1] for r in got) <= 200


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch, spark):
    text = b"alpha beta " * 50 + b"x" * 40
    assert b"".join(divergence.cut(text, 64)) == text
    assert all(not (a[-1:].isalpha() and b[:1].isalpha()) for a, b in zip(divergence.cut(text, 64), divergence.cut(text, 64)[1:]))
    huge = "Alpha beta " * 300_000
    got = {r["term"]: (r["n"], r["docs"]) for r in divergence.counted(spark.createDataFrame([(1, huge, "en", "a")], "doc_id long, text string, lang string, source string")).collect()}
    assert got == {"alpha": (300_000, 1), "beta": (300_000, 1)}


def test_share_is_exact():
    rng = np.random.default_rng(3)
    total = rng.integers(1, 9 * 10**15, 2000)
    n = np.minimum(rng.integers(0, 9 * 10**15, 2000), total - 1)
    assert [int(v) for v in divergence.share(n, total)] == [1 + (10**9 * (int(a) + 1)) // int(b) for a, b in zip(n, total)]
