"""Text operators against plain brute force."""

import re
import zlib
from collections import defaultdict

import pytest
import xxhash

from corpusloom.llm import decontam, linededup, packing, simhash, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(6000))
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "The quick Brown fox jumps."), (7, "The quick Brown fox jumps."),
    (8, LONG), (9, LONG + " tail"), (10, "é ü ß İstanbul naïve… don't it's 3.5% A'll __x__ 🙂 <b>"), (11, "a b c"), (12, "x " * 300), (13, "x " * 300),
    (14, "élève É"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in EDGE], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def check_packing(df, size=4096):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    import numpy as np

    rows = packing.pack(df, size=size).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts(df).items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        got = sorted(by[doc], key=lambda r: r["piece"])
        assert [r["start"] for r in got] == list(range(0, len(ids), size)), doc
        for r in got:
            part = ids[r["start"] : r["start"] + size]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes())), doc
    total = 0
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
        total += at
    return len(seqs), -(-total // size)


def test_packing(edge, real):
    check_packing(edge)
    used, least = check_packing(real)
    assert used <= least + 2
    assert packing.pack(real.limit(0)).count() == 0


def test_packing_evolves():
    """Three pieces fill a sequence exactly: best fit needs more sequences than
    crossovers do."""
    import numpy as np

    fewer = 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        a = rng.integers(1040, 1900, 40)
        b = rng.integers(1040, 1500, 40)
        lengths = rng.permutation(np.concatenate([a, b, 4096 - a - b]))
        order = np.argsort(-lengths, kind="stable")
        plain = len(np.unique(packing.best_fit(lengths, order, [], 0, 4096)))
        best, crossings = packing.evolve(lengths, [], 4096, 8, 400, seed)
        fill = np.bincount(best, weights=lengths)
        assert fill.max() <= 4096 and crossings > 0
        used = int((fill > 0).sum())
        assert used <= plain
        fewer += used < plain
    assert fewer > 0


def test_packing_islands_cross_and_migrate(real):
    import public_tokenizers

    loose = packing.pieces(real, public_tokenizers.path("word_bpe_49k.json"), 1, 4096).where("length < 4096").selectExpr("*", "doc_id as salt", "0L as shard")
    state = packing.island_states(loose, 4096, 3, 2, 4, 12).collect()
    assert {r["island"] for r in state} == {0, 1, 2}
    assert all(r["crossings"] > 0 for r in state)


def test_packing_shards(real):
    rows = packing.pack(real, shard_items=40).collect()
    fill = defaultdict(int)
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096
    assert len(fill) <= 1.1 * sum(fill.values()) / 4096 + 2


def brute_simhash(all_texts):
    prints = {}
    for doc, text in all_texts.items():
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        words = WORD.findall(low)
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        ones = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, seed=42)
            for b in range(64):
                ones[b] += h >> b & 1
        prints[doc] = sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))
    docs = sorted(prints)
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (prints[d], find(d)) for d in docs}


def test_simhash(edge, real):
    for df in (edge, real):
        got = {r["doc_id"]: (r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
        assert got == brute_simhash(texts(df))
    assert simhash.near_duplicates(real.limit(0)).count() == 0


@pytest.mark.parametrize("most", [2, simhash.MOST, 10**6])
def test_simhash_links_in_dense_postings(spark, most):
    """Chains of flips: no link may be lost where postings are full."""
    import random

    rng = random.Random(3)
    values = {0}
    while len(values) < 400:
        values.add(rng.choice(list(values)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint long")
    edges = {(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.links(df, most=most).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                assert find(a) == find(b)


def test_tally_counts_shared_bytes():
    import numpy as np

    a = 0x0102030405060708
    members = np.array([a, a ^ 1, a ^ (1 << 8), a ^ 0x0101, a ^ 0x010101, 5, 5 ^ (7 << 60)], np.uint64)
    got = set(zip(*(x.tolist() for x in simhash.tallied(members, np.array([5, 2]), 2))))
    five = members[:5].tolist()
    assert got == {(p, q) for k, p in enumerate(five) for q in five[k + 1 :]} - {(five[0], five[4])}
    i, j = simhash.pairs_of(np.array([3, 1, 2]))
    assert list(zip(i, j)) == [(0, 1), (0, 2), (1, 2), (4, 5)]


def brute_lines(rows, min_words):
    """Lines covered by the longest run from each start that also starts
    earlier, where that run has ``min_words`` words."""
    starts, out = defaultdict(list), []
    for text in rows:
        lines = (text or "").split("\n")
        own = [i for i, x in enumerate(lines) if WORD.search(x.encode())]
        seq, words = [lines[i] for i in own], [len(WORD.findall(lines[i].encode())) for i in own]
        cut = set()
        for k, line in enumerate(seq):
            for other, t in starts[line]:
                n = 0
                while k + n < len(seq) and t + n < len(other) and seq[k + n] == other[t + n]:
                    n += 1
                if sum(words[k : k + n]) >= min_words:
                    cut.update(own[k : k + n])
            starts[line].append((seq, k))
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in cut), len(cut)))
    return out


def check_lines(df, rows):
    from collections import Counter

    got = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in linededup.drop_repeated_lines(df).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute_lines([t for _, t in rows], linededup.MIN_WORDS)))


def test_line_dedup(spark, edge, real):
    passage = "\n".join(f"line {i} has some words here" for i in range(12))
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    tail = "\n".join([words("a", 30), words("b", 30), words("c", 10)])  # the last line ends the run
    short = "\n".join([words("d", 60), *[f"e{k}" for k in range(49)]])
    made = [(100, f"start one\n{passage}\nend"), (101, f"other\n\n{passage}\n\nrest"), (102, "\n".join(["same words again and again"] * 40)), (103, "\n".join(passage.split("\n")[:5])), (104, passage.replace("\n", "\n \n")), (105, passage + "\n" + passage)]
    made += [(110, tail + "\nx"), (111, "y\n" + tail + "\nz"), (112, short + "\nx"), (113, short + "\ny"), (114, "\n".join(f"one{k % 7}" for k in range(150)))]
    df = edge.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], DOCS))
    out = linededup.drop_repeated_lines(df.withColumnRenamed("source", "_spans").withColumnRenamed("lang", "cuts"))
    assert out.columns[:5] == ["doc_id", "text", "cuts", "_spans", "n_chars"]
    for table in (df, real):
        check_lines(table, sorted((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect() if r["text"] is not None) if table is real else sorted(((r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text").collect())))
    assert linededup.drop_repeated_lines(real.limit(0)).count() == 0


def test_line_dedup_of_equal_ids(spark):
    passage = "\n".join(f"line {i} has some words here" for i in range(12))
    own = "\n".join(f"row {i} is quite another text" for i in range(15))
    rows = [(7, passage), (7, own), (8, passage + "\nend"), (8, own), (9, own), (9, own), (None, passage), (None, None)]
    got = defaultdict(list)
    for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["text"], r["n_removed"]))
    assert sorted(got[7]) == sorted([(passage, 0), (own, 0)])
    assert sorted(got[8]) == [("", 15), ("end", 12)] and got[9] == [("", 15)] * 2
    assert sorted(got[None]) == [("", 0), ("", 12)]


def test_decontamination(spark, edge, real, sf):
    items = [
        (1, "Alice bought 3 apples and 4 pears at the market in Paris for 12 dollars , how much did she pay ?"),
        (2, "short item"),
        (3, None),
        (4, "the wind in the willows blows over many hills and valleys"),
    ]
    docs = [
        (1, "Noise first. " + items[0][1] + " And more."),
        (2, "It says that Alice bought 7 apples and 9 pears at the market in Berlin for 55 dollars , how much did she pay ?"),
        (3, "It says that Alice bought 5 apples and 5 pears at the market in Berlin for 55 dollars , how much did she pay ?"),
        (4, "She bought apples and pears at the market."),
        (5, "Short item"),
        (9, "here is a short item indeed"),
        (6, "the wind in the willows blows over many hills and valleys"),
        (7, None),
        (8, ""),
    ]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.find(d, b).collect()}
    assert got == {(1, 1): True, (2, 1): False, (5, 2): True, (6, 4): True}  # 3: one value for two of the item's
    wide = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.find(d, b, most_broadcast=0).collect()}
    assert wide == got
    assert {r["doc_id"] for r in decontam.drop_contaminated(d, b).collect()} == {3, 4, 7, 8, 9}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = {(i, r["item_id"]) for i, t in texts(real).items() for r in bench.collect() if r["text"] in t}
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find(real, bench).collect()}
    assert whole <= found and len(found - whole) <= 0.1 * len(whole) + 1
    assert decontam.find(real.limit(0), bench).count() == 0
    assert decontam.find(real, bench.limit(0)).count() == 0


def test_decontamination_names(spark):
    item = "Anna has 3 apples in her old basket. Ben has 4 pears in a paper bag. Cara Smith lives in Paris near the long river. How many fruits do they have together ?"
    other = "Noise first. Dora has 7 apples in her old basket. Emil has 9 pears in a paper bag. Fred lives in New York near the long river. How many fruits do they have together ?"
    docs = [
        (1, item),
        (2, other),
        (3, other.replace("Emil", "Dora")),  # one name for two
        (4, "Noise first. Dora sold 7 houses in her old street. Emil has 9 pears. Nobody knows how many fruits they have."),
    ]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    for options in ({}, {"most_broadcast": 0}):
        assert {r["doc_id"]: r["exact"] for r in decontam.find(d, b, **options).collect()} == {1: True, 2: False}


def test_toxicity(spark, edge, sf):
    folder = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = labels.where("doc_id % 3 <> 0")
    model = toxicity.fit(toxicity.training_sample(docs, half, 500))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    rest = [(scored[r["doc_id"]] >= 0.7, r["toxic"]) for r in labels.where("doc_id % 3 = 0").collect()]
    hit = sum(p and t for p, t in rest)
    assert hit / sum(t for _, t in rest) > 0.6
    assert hit / max(1, sum(p for p, _ in rest)) > 0.85
    out = {r["doc_id"]: r["score"] for r in toxicity.score(edge, model).collect()}
    assert len(out) == len(EDGE) and out[1] == out[2] == out[3] and all(0 <= x <= 1 for x in out.values())
    kept = toxicity.drop_toxic(edge.withColumnRenamed("lang", "score"), model)
    assert kept.count() == sum(x < 0.7 for x in out.values())
    none = toxicity.fit(toxicity.training_sample(docs, labels.limit(0), 500))
    assert {round(r["score"], 6) for r in toxicity.score(edge, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


