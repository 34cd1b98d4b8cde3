"""The backoff model against a plain dictionary version."""

import math
import re
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import katz, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [*WORD.findall(low), "END"]


def brute(train, texts, order):
    grams = [Counter() for _ in range(order + 1)]
    for t in train:
        w = ["START"] * (order - 1) + tokens(t)
        for i in range(order - 1, len(w)):
            for k in range(1, order + 1):
                grams[k][tuple(w[i - k + 1 : i + 1])] += 1
    total, types = sum(grams[1].values()), len(grams[1])
    d = [None] + [katz.discounts(Counter(g.values())) for g in grams[1:]]
    left = lambda c, k: c * d[k][c - 1] if c <= katz.K else c
    freed = sum(c - left(c, 1) for c in grams[1].values())
    size = total if freed > 0 else total + 1
    p = {w: left(c, 1) / max(size, 1) for (w,), c in grams[1].items()}
    unknown = 1 - sum(p.values())
    prob, alpha = {}, {}

    def value(k, h, w):
        if k == 1:
            return p.get(w, unknown)
        h = h[len(h) - k + 1 :]
        if w in prob.get(h, {}):
            return prob[h][w]
        return alpha.get(h, 1.0) * value(k - 1, h, w)

    for k in range(2, order + 1):
        after = defaultdict(dict)
        for gram, c in grams[k].items():
            after[gram[:-1]][gram[-1]] = c
        for h, ws in after.items():
            n = sum(ws.values())
            n += sum(c - left(c, k) for c in ws.values()) <= 0
            got = {w: left(c, k) / n for w, c in ws.items()}
            alpha[h] = (1 - sum(got.values())) / (1 - sum(value(k - 1, h, w) for w in ws))
            prob[h] = got
    for h in list(prob)[:: max(1, len(prob) // 40)]:
        every = sum(value(order, ("?",) * order + h, w) for w in p) + value(order, ("?",) * order + h, "never seen")
        assert math.isclose(every, 1, abs_tol=1e-9) or len(h) + 1 < order
    out = {}
    for doc, t in texts.items():
        w = ["START"] * (order - 1) + tokens(t)
        score = sum(math.log10(value(order, tuple(w[:i]), w[i])) for i in range(order - 1, len(w)))
        own = w[order - 1 :]
        base = sum(math.log10((grams[1][(x,)] + 1) / (total + types + 1)) for x in own)
        out[doc] = (len(own), sum(grams[1][(x,)] > 0 for x in own), base, score)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for doc, (n, known, base, score) in want.items():
        r = got[doc]
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9), doc


@pytest.mark.parametrize("real, order", [(False, 2), (False, 3), (False, 4), (True, 2), (True, 3)])
def test_scores(spark, sf, real, order, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 100_000 if real else 40)
    if real:
        df = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as doc", "text", "lang as v", "source as block")
    else:
        rows = ["the cat sat on the mat", "The cat sat", None, "", "the dog sat on the log on the mat", "x y z x y z x y z x y", "unknown words here the cat"] + ["a b"] * 9
        df = spark.createDataFrame(list(enumerate(rows)), "doc long, text string")
    train = df.where("doc % 3 <> 1")
    model = katz.fit(train, order)
    got = {r["doc"]: r for r in katz.score(df.select("doc", "text"), model).collect()}
    want = brute([r["text"] for r in train.collect()], {r["doc"]: r["text"] for r in df.collect()}, order)
    same(got, want)
    both = df.selectExpr("doc", "text", "doc % 3 <> 1 as learn")
    same({r["doc"]: r for r in katz.fit_and_score(both, order)[1].collect()}, want)
    if real:
        held = [d for d in want if d % 3 == 1]
        assert sum(want[d][3] for d in held) > sum(want[d][2] for d in held)


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (2, "a")], "doc long, text string")
    model = katz.fit(df.limit(0))
    assert sorted((r["doc"], r["n_tokens"], r["n_known"], r["score"]) for r in katz.score(df, model).collect()) == [(1, 3, 0, 0.0), (2, 1, 0, 0.0), (2, 2, 0, 0.0)]
    assert katz.score(df.limit(0), katz.fit(df)).count() == 0


def test_query(spark, sf):
    out = queries.op5_katz(spark, sf)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = out.collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs) and {r["held_out"] for r in rows} == {True, False}
