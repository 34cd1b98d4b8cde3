"""Steps that grew faster than their input, against plain versions."""

import hashlib

from pyspark.sql import functions as F

from corpusloom.operators import corpus, retrieval, segmentation, tasks


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def plain_negatives(pairs, pool, n, buckets):
    h = lambda s: hashlib.md5(s.encode()).hexdigest()
    out = []
    for qid, pos in pairs:
        draw = int(h(f"42:{qid}")[:8], 16) % buckets
        some = [x for x in set(pool) if int(h(str(x))[:8], 16) % buckets == draw and x != pos]
        out += [(qid, pos, x, r + 1) for r, x in enumerate(sorted(some, key=lambda x: (h(f"42:{qid}:{x}"), x))[:n])]
    return sorted(out)


def test_negatives_rank_few_hashes(spark):
    pairs = [(i, i % 50) for i in range(120)]
    pool = list(range(900))
    p, q = spark.createDataFrame(pairs, "qid long, id long"), spark.createDataFrame([(x,) for x in pool], "id long")
    for n, buckets in ((7, 4), (7, 64), (1, 2)):  # of 64 buckets none is cut
        for ranked in (None, 1, 8):  # so few that many qids rank their whole bucket
            assert rows_of(corpus.negatives(p, q, n, buckets, ranked=ranked)) == plain_negatives(pairs, pool, n, buckets)


def test_negatives_are_hashed_in_blocks(spark, monkeypatch):
    from corpusloom.operators import drawn

    for name, size in (("ASKER_BLOCK", 40), ("POOL_BLOCK", 50), ("CELLS", 64), ("RANKED", 30), ("TASK", 1000)):
        monkeypatch.setattr(drawn, name, size)
    # keys of every length, some with more bytes than md5 reads at once
    pairs = [(q, i % 3) for i, q in enumerate(["", "路", "x" * 47, "y" * 60, *(str(7**k) for k in range(3, 22)), *map(str, range(70))])]
    pool = ["", "é", "z" * 58, *(str(3**k) for k in range(30)), *map(str, range(200))]
    p = spark.createDataFrame([*pairs, (None, 1), ("1", None)], "qid string, id long").withColumn("id", F.col("id").cast("string"))
    q = spark.createDataFrame([(x,) for x in [*pool, "7", None]], "id string")
    want = sorted((a, str(b), c, r) for a, b, c, r in plain_negatives([(a, str(b)) for a, b in pairs], pool, 7, 2))
    for ranked in (None, 1):
        got = corpus.negatives(p.distinct(), q, 7, 2, ranked=ranked)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroupsInArrow" in plan and "Join" not in plan  # no row, and no text, for a pair
        assert sorted(set(rows_of(got))) == sorted(set(want))


def test_first_word_of_md5():
    import numpy as np

    from corpusloom.operators import drawn

    for heads, tails in (("42:7:", "1234567"), ("42:1234567:", "89"), ("a", "b" * 54), ("abcd", ""), ("", "x"), ("a" * 30, "b" * 40)):
        matrix = lambda t: np.frombuffer(t.encode(), np.uint8).reshape(1, -1)
        assert drawn._below(matrix(heads), matrix(tails), 2**32 - 1)[2].tolist() == [int(hashlib.md5((heads + tails).encode()).hexdigest()[:8], 16)]


def test_lexicon_counts_tags_once(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], ("N", "V", "N/V")[i % 3]) for i in range(3000)], "ord long, word string, tags string")
    lexicon = segmentation.load_lexicon(rows)
    assert rows_of(lexicon) == [("a", ["N", "V"]), ("b", ["V", "N"])]
    # the lists hold distinct tags, not all rows of a word
    assert "min(ord" in lexicon._jdf.queryExecution().toString()


def test_segment_sends_a_small_lexicon(spark):
    lexicon = spark.createDataFrame([("ab", ["N"]), ("a", ["V"]), ("c", ["N"])], "word string, tags array<string>").checkpoint()
    sentences = spark.createDataFrame([(1, "abac，d"), (2, "")], "id long, sentence string")
    out = segmentation.segment(sentences, lexicon)
    assert [r["token"] for r in out.orderBy("pos").collect()] == ["ab", "a", "c", "，", "d"]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_lexical_fast_against_every_pair(spark):
    entries = [(i, f"h{i % 7}", f"d{i % 3}") for i in range(60)] + [(60, "d0", "d1"), (61, "x", "h1"), (62, "h9", "d0"), (62, "h9", "d0")]
    queries = [(q, o, v) for q, vs in enumerate((["d0"], ["h1", "d1"], ["d1", "h1"], ["d0", "d1", "h9"], ["d0", "h9"], ["h3", "zz"], [""])) for o, v in enumerate(vs)]
    e = spark.createDataFrame(entries, "id long, headword string, definition string")
    q = spark.createDataFrame(queries, "qid long, ord int, variant string")
    last = {h: i for i, h, _ in sorted(entries)}
    for n in (1, 4, 50):
        want = []
        for qid in {x[0] for x in queries}:
            first = {}
            for _, o, v in (x for x in queries if x[0] == qid):
                for t, s, ids in ((0, 20.0, [last[v]] if v in last else []), (1, 18.0, [i for i, _, d in entries if v and d == v])):
                    for i in ids:
                        first[i] = min(first.get(i, (9, 9, 0.0)), (o, t, s))
            best = sorted((-s, i) for i, (_, _, s) in first.items())[:n]
            want += [(qid, i, -s, r + 1) for r, (s, i) in enumerate(best)]
        got = retrieval.lexical_fast(q, e, n)
        assert rows_of(got.select("qid", "id", "score", "rk")) == sorted(want)




def test_equal_terms_are_matched_once(spark, monkeypatch):
    stored = []
    kept = tasks.shared
    monkeypatch.setattr(tasks, "shared", lambda df: stored.append(kept(df)) or stored[-1])
    items = spark.createDataFrame([(i, f"head {i % 5}", f"word{i % 3} x") for i in range(40)], "id long, headword string, definition string")
    lists = [["word1"], ["head 3"], ["zzz"], ["ead 2", "word2"], ["word2", "ead 2"], ["word1", "word1"]]
    rows = spark.createDataFrame([(i, lists[i % 6]) for i in range(600)], "rid long, terms array<string>")
    got = dict(rows_of(tasks.best_matches(rows, items).select("rid", "id")))
    assert {i: got.get(i) for i in range(6)} == {0: 1, 1: 3, 2: None, 3: 2, 4: 2, 5: 1}
    assert len(got) == 500 and all(got[i] == got[i % 6] for i in got)
    assert stored[-1].columns == ["terms", "kind"] and stored[-1].count() == 4


def test_gram_match_against_every_pair(spark):
    left = [(i, ["Ring#%d" % i, "bolt", "xyz9", "ring bolt"][i % 4]) for i in range(80)]
    right = [(i, ["old ring", "hot bolt", "blue plate"][i % 3]) for i in range(30)]
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    posts = {}
    for i, t in right:
        for g in grams(t):
            posts.setdefault(g, []).append(i)
    want = []
    for l, t in left:
        score = {}
        for g in grams(t):
            for i in sorted(posts.get(g, []))[:6]:
                score[i] = score.get(i, 0) + len(g)
        if score:
            want.append((l, *max(score.items(), key=lambda x: (x[1], -x[0]))))
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    assert rows_of(corpus.gram_match(frame(left), frame(right), 6)) == sorted(want)


def test_lookup_meets_few_of_equal_entries(spark, monkeypatch):
    sizes = []
    kept = retrieval.containing
    monkeypatch.setattr(retrieval, "containing", lambda texts, words: sizes.append(texts.count()) or kept(texts, words))
    entries = spark.createDataFrame([(i, f"big {i % 4} ring", f"d{i % 2}") for i in range(400)], "id long, headword string, definition string")
    asked = spark.createDataFrame([(0, "ring"), (1, "d1"), (2, "big 3"), (3, "none")], "qid long, term string")
    got = rows_of(retrieval.substring_search(asked, entries, 3).select("qid", "id", "rk"))
    assert got == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 1, 1), (1, 3, 2), (1, 5, 3), (2, 3, 1), (2, 7, 2), (2, 11, 3)]
    assert sizes == [12, 12]
    index = retrieval.exact_index(entries)
    assert rows_of(index.where("key = 'd1'").select("headword", "id")) == [("big 1 ring", 1), ("big 3 ring", 3)]


def test_bm25_in_blocks_against_every_pair(spark, monkeypatch):
    import math
    import random

    from corpusloom.operators import ranked

    monkeypatch.setattr(ranked, "DOC_BLOCK", 60)
    monkeypatch.setattr(ranked, "QUERY_BLOCK", 10)
    monkeypatch.setattr(ranked, "CELLS", 40)
    r = random.Random(5)
    texts = [[r.choice("aaaabbbccde") for _ in range(r.randrange(9))] for _ in range(120)] + [list("ab")] * 40
    # ids that stand twice, with texts of one and of two lengths, and null ones
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, list("abc")), (3, list("abd")), (4, ["c"]), (None, list("ab")), (None, ["b"]), (500, None)]
    asked = [(q, o, list(w)) for q, vs in enumerate((["ab", "c"], ["aab"], ["zz", "e"], ["z"], ["abcde", "d", "b"])) for o, w in enumerate(vs)]
    d = spark.createDataFrame(docs, "id long, tokens array<string>")
    q = spark.createDataFrame([(i, o, t) for i, o, w in asked for t in w], "qid long, ord int, token string")
    full = [t for _, t in docs if t is not None]
    mean = sum(map(len, full)) / len(full)
    for counted in (False, True):
        posts = {}
        for i, t in docs:
            for w in t or []:
                posts.setdefault(w, []).append((i, len(t)))
        tfs = {w: [(x, p.count(x)) for x in dict.fromkeys(p)] if counted else [(x, 1) for x in p] for w, p in posts.items()}
        for n in (1, 3, 300):
            want = []
            for qid, o, words in asked:
                score = {}
                for w in words:
                    for (i, dl), tf in tfs.get(w, []):
                        idf = math.log(1 + (len(docs) - len(tfs[w]) + 0.5) / (len(tfs[w]) + 0.5))
                        score[i] = score.get(i, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
                best = sorted((-round(s, 6), -1 if i is None else i) for i, s in score.items() if round(s, 6) > 0)[:n]
                want += [(qid, o, i, f"{-s:.5f}", rk + 1) for rk, (s, i) in enumerate(best)]
            got = retrieval.bm25(retrieval.Index(d, d["tokens"], counted=counted), q, n, ["qid", "ord"])
            plan = got._jdf.queryExecution().toString()
            assert "CoGroupsInArrow" in plan and "hashpartitioning(token" not in plan.split("CoGroupsInArrow")[0]
            assert sorted((r.qid, r.ord, -1 if r.id is None else r.id, f"{r.score:.5f}", r.rk) for r in got.collect()) == sorted(want)


def test_pairs_take_prepared_columns(spark, sf):
    """Regular expressions on headwords and definitions run on entries, before
    these meet the queries."""
    import re

    from corpusloom.plans import catalog

    for name in ("r12_field_match", "r19_heuristic_rerank", "r20_features"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.rindex("Join Inner")].split("Generate")[0]
        joined = "\n".join(line for line in above.split("\n") if not re.match(r"[\s:+-]*:", line))
        assert "regexp_" not in joined.split("Join Inner")[0], name
        assert "definition" not in joined or "regexp" not in joined.split("Join Inner")[0]


def test_char_counts(spark):
    from corpusloom.functions import tokens as K

    texts = ["", "a", "aab", "abcabc", "路路x", "xyzz路"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string").select("a", "b", K.chars_in(K.char_counts("a"), "b").alias("n"), K.char_overlap("a", "b").alias("m"))
    assert all(r.n == r.m == sum(min(r.a.count(c), r.b.count(c)) for c in set(r.a)) for r in rows.collect())
