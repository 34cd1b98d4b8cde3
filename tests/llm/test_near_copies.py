"""Near-duplicate stage of the pipeline against all pairs by brute force."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from corpusloom.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """Kept (doc_id, text) rows, and the number of similar pairs of different sets."""
    sets, inverted = [shingles(t) for _, t in rows], defaultdict(list)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs, same = 0, {}
    for i, s in enumerate(sets):
        root[i] = find(same.setdefault(s, i))
        if root[i] != i:
            continue
        for j, n in Counter(j for x in s for j in inverted[x]).items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                pairs += 1
                root[find(i)] = find(j)
        for x in s:
            inverted[x].append(i)
    best = {}
    for i, (doc, text) in enumerate(rows):
        at = find(i)
        best[at] = min(best.get(at, (2, 0, 0)), (doc is None, doc or 0, i))
    return Counter(rows[i] for _, _, i in best.values()), pairs


def check(spark, sf, df):
    out = corpus_pipeline.dedup_near(spark, df, sf)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    want, pairs = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == want
    return pairs


def test_near_copies(spark, sf):
    rng = random.Random(5)
    base = [f"word{rng.randrange(10**6)}" for _ in range(60)]
    changed = lambda *places: " ".join("new" + str(k) if k in places else w for k, w in enumerate(base))
    hot = [" ".join(base[:25] + [f"x{i}y{k}" for k in range(40)]) for i in range(30)]
    rows = [(7, " ".join(base)), (3, changed(30)), (4, changed(10, 30)), (5, changed(10, 30, 50)), (9, changed(5, 15, 25, 35, 45)), (None, "alone without an id " * 3), (None, "other row without an id"), (6, " ".join(base).upper()), (6, "same id but another text here"), (6, "one"), (8, None), (2, ""), (1, "a b c"), (11, "a b c d e f")]
    rows += [(100 + i, t) for i, t in enumerate(hot)]
    rows += [(200 + i, changed(59 - i % 3) + f" end{i}") for i in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3).cache()
    assert check(spark, sf, df) >= 3
    assert corpus_pipeline.dedup_near(spark, df.limit(0), sf).count() == 0


def test_near_copies_of_the_table(spark, sf):
    folder = sf.replace("0.001", "0.01")
    assert check(spark, folder, spark.read.parquet(f"{folder}/documents.parquet")) > 0


def test_few_pairs_of_texts_that_cannot_link(spark, sf, monkeypatch):
    """Texts that share a passage, or an original with other words changed in
    each, meet in many postings; pairs too far apart to link aren't made."""
    base = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join(base[:60] + [f"x{i}y{k}" for k in range(22)])) for i in range(150)]
    rows += [(1000 + 80 * p + q, " ".join("new" + w if k in (p, q) else w for k, w in enumerate(base))) for p in range(8, 72, 8) for q in range(p + 8, 72, 4)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(3).cache()
    made, real = [], simhash.stored

    def spy(table, name):
        out = real(table, name)
        made.extend([out.count()] if name == "near-tried" else [])
        return out

    monkeypatch.setattr(simhash, "stored", spy)
    check(spark, sf, df)
    assert sum(made) < 6 * len(rows)
