"""Repeated substrings against brute force."""

import numpy as np
import pytest

from corpusloom.llm import runindex


def brute(texts, span=100):
    out, seen = {}, set()
    for doc in sorted(texts):
        data = (texts[doc] or "").encode()
        cut = np.zeros(len(data), bool)
        for i in range(len(data) - span + 1):
            key = data[i : i + span]
            if key in seen:
                cut[i : i + span] = True
            seen.add(key)
        runs = int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum())
        out[doc] = (bytes(np.frombuffer(data, np.uint8)[~cut]), len(data), int(cut.sum()), runs)
    return out


def compare(df, **options):
    texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    got = {r["doc_id"]: (bytes(r["text"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in runindex.remove_repeats(df, **options).collect()}
    want = brute(texts)
    assert got.keys() == want.keys()
    for doc in want:
        assert got[doc] == want[doc], (doc, got[doc][1:], want[doc][1:])


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(1)
    word = lambda n: " ".join("".join(rng.choice(list("abcdeé"), rng.integers(2, 8))) for _ in range(n))
    passage, line = word(60), word(12)
    rows = [None, "", "short", "a" * 99, "a" * 100, "a" * 350, "ab" * 200, passage, word(5) + passage[20:200] + word(40), passage, passage[:99], passage[:100], passage[1:101] + passage[:150]]
    rows += [word(30) + line + word(30) for _ in range(30)] + [passage[i : i + 130] + word(9) for i in range(0, 60, 7)]
    rows += ["é" * 120, "x" + "é" * 120, "\0" * 150, passage.replace(" ", "\n")]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("doc_id", "text", "doc_id as doc", "text as spans").repartition(4).cache()


def test_made(made):
    compare(made)
    compare(made, bucket_bytes=3000)


@pytest.mark.parametrize("listed", [1 << 16, 20])
def test_hot_anchors(made, listed, monkeypatch):
    monkeypatch.setattr(runindex, "LISTED", listed)
    compare(made, bucket_bytes=400)


def test_real(spark, sf):
    compare(spark.read.parquet(f"{sf}/documents.parquet"))


def test_equal_ids(spark):
    """Rows of one doc_id with other texts lose only what is repeated."""
    rng = np.random.default_rng(2)
    word = lambda n: " ".join("".join(rng.choice(list("abcde"), rng.integers(2, 8))) for _ in range(n))
    a, b, c = word(80), word(80), word(80)
    rows = [(1, a), (1, b), (1, c + a), (None, c + " " + b[:150]), (2, b), (2, b)]
    got = runindex.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    left = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in got}
    assert left[1, len(b)] == 0 and left[2, len(b)] == len(b) and left[None, len(c) + 151] > 0
    assert left[1, len(a)] in (0, len(a)) and left[1, len(a)] + left[1, len(a) + len(c)] >= len(a) - 1


def test_empty(made):
    assert runindex.remove_repeats(made.limit(0)).count() == 0


def test_run_index_is_smaller_than_its_text():
    body = b"the same text again and again, and then some more of it. " * 4
    index = runindex.RunIndex([body] * 20)
    assert index.runs < index.size / 5


def test_hot_anchors_make_few_rows(spark, monkeypatch):
    """A common line makes rows by its neighbourhoods, not by their bytes."""
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("".join(rng.choice(list("abcde"), rng.integers(2, 8))) for _ in range(n))
    line, made = word(14), []
    rows = [(i, word(30) + line + word(30)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **b: made.append(real(self, *a, **b)) or made[-1])
    compare(df, bucket_bytes=2000)
    assert max(m.count() for m in made) < sum(len(t) for _, t in rows) / 20
