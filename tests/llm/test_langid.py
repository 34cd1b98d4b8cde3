"""Language identification: sums over segmentations by enumeration, held-out
accuracy, and rows of every kind."""

import numpy as np

from corpusloom.llm import langid, queries

PIECES = [b" a", b"ab", b" ab", b"b", b"abc", b"bc", b" abca"]


def splits(word, known):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in known:
            for rest in splits(word[n:], known):
                yield [word[:n], *rest]


def small_model():
    known = langid.Vocabulary(PIECES)
    uses = np.random.default_rng(5).random((known.size, 2)) + 0.01
    return langid.Model(["x", "y"], known, uses, 0.01)


def plain_probabilities(model):
    names = list(dict.fromkeys([bytes([b]) for b in range(256)] + PIECES))
    return {p: model.scaled[i] / 2.0 ** (langid.SCALE * len(p)) for i, p in enumerate(names)}


def test_forward_sums_all_segmentations():
    model = small_model()
    prob = plain_probabilities(model)
    words = [b" abcabab", b" a", b" abca", b" zz", b" bcbc"]
    total, count = model.scores([b" abcabab a", b" abca", b"", b" zz bcbc zz"])
    one = {w: np.sum([np.prod([prob[p] for p in cut], axis=0) for cut in splits(w, prob)], axis=0) for w in words}
    want = [np.log(one[b" abcabab"]) + np.log(one[b" a"]), np.log(one[b" abca"]), np.zeros(2), 2 * np.log(one[b" zz"]) + np.log(one[b" bcbc"])]
    assert np.allclose(total, want) and list(count) == [2, 1, 0, 3]


def test_expected_counts():
    model = small_model()
    prob = plain_probabilities(model)
    words = langid.Distinct([b" abcab", b" abca abca"])
    n = np.zeros((len(words.length), 2))
    np.add.at(n, words.word, 1.0)
    got = langid.expected(words, n, model.vocabulary, model.scaled)
    names = list(dict.fromkeys([bytes([b]) for b in range(256)] + PIECES))
    want = np.zeros_like(got)
    for word, times in ((b" abcab", 1), (b" abca", 2)):
        cuts = [*splits(word, prob)]
        weight = np.array([np.prod([prob[p] for p in cut], axis=0) for cut in cuts])
        for cut, w in zip(cuts, weight / weight.sum(axis=0)):
            for p in cut:
                want[names.index(p)] += times * w
    assert np.allclose(got, want)


def test_long_runs_stay_finite():
    total, count = small_model().scores([b" " + b"ab" * 5000, b" " + b"\xff" * 1000])
    assert np.isfinite(total).all() and list(count) == [167, 17]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = queries.QUERIES["op12_language"](spark, sf).join(docs, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == docs.count() and len(held) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_rows_of_every_kind(spark):
    rows = [(1, "le chat noir dort", "fr", "a"), (2, "the black cat sleeps", "en", "b"), (2, "the black cat sleeps", "en", "b"), (None, "the cat", "en", None), (3, None, "en", None), (4, "", None, None), (5, "123 --- €", "fr", None), (6, "THE CAT", None, None), (7, "le noir", None, "s"), (8, "cat " * 400_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(docs, sample=5)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()]
    assert model.langs == ["en", "fr"] and len(got) == len(rows)
    by = {i: p for i, p, _ in got}
    assert by == {1: "fr", 2: "en", None: "en", 3: "und", 4: "und", 5: "und", 6: "en", 7: "fr", 8: "en"}
    assert all(s == 0 for _, p, s in got if p == "und")
    none = langid.fit(docs.where("false"))
    assert none is None and {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0
