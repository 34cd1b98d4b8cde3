"""The filter before joins, and what it spares the pipeline's stages."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from corpusloom.llm import decontam, simhash
from corpusloom.llm.common import chunks, sieve, stored, without
from pyspark.sql import functions as F


@pytest.mark.parametrize("most", [24, 8])
def test_sieve(spark, most):
    keys = stored(spark.range(0, 300_000, 100).select((F.col("id") - 150_000).alias("k")), "keys")
    rows = spark.range(300_000).select((F.col("id") - 150_000).alias("_bits"), F.lit("x").alias("_word"), F.lit(None).cast("int").alias("odd.name"))
    maybe, sure = sieve(keys, most)(rows, "_bits")
    assert maybe.columns == sure.columns == rows.columns
    assert maybe.count() + sure.count() == 300_000
    assert sure.join(keys, F.col("_bits") == F.col("k")).count() == 0
    assert maybe.join(keys, F.col("_bits") == F.col("k")).count() == 3000
    if most == 24:
        assert maybe.count() < 60_000
    left = without(rows, "_bits", keys)
    assert left.columns == rows.columns and left.count() == 297_000
    none = stored(keys.limit(0), "keys")
    assert without(rows, "_bits", none).count() == 300_000 and without(rows.limit(0), "_bits", keys).count() == 0


def test_only_likely_texts_are_compared(spark, sf, monkeypatch):
    """The wide fingerprints that pairs are joined with are those of texts that
    may link, not of the whole table."""
    rng = random.Random(3)
    alone = [" ".join(f"w{rng.randrange(10**7)}" for _ in range(40)) for _ in range(400)]
    near = [" ".join([*alone[0].split(), f"end{i}"]) for i in range(3)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(alone + near)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
    joined, real = [], simhash._enough

    def spy(pairs, nodes, *rest):
        joined.append(nodes.count())
        return real(pairs, nodes, *rest)

    monkeypatch.setattr(simhash, "_enough", spy)
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_near(spark, df, sf).collect()) == list(range(400))
    assert joined and max(joined) < 20


def test_words_seen_are_small():
    """A worker keeps what it knows of words in arrays, with the same reading
    whatever it has seen before."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Mary", "5", "km", "goes.", "to", f"w{rng.randrange(10**6)}"]) for _ in range(500)).encode() for _ in range(20)]
    fresh = []
    for text in texts:
        decontam.Templates._known = tuple(x[:0] for x in decontam.Templates._known)
        fresh.append([(f.token.tolist(), f.value.tolist()) for f in decontam.Templates([text]).forms])
    again = [[(f.token.tolist(), f.value.tolist()) for f in decontam.Templates([text]).forms] for text in [*texts, *texts]]
    assert again == fresh + fresh
    assert sum(x.nbytes for x in decontam.Templates._known) <= 18 * len({w for t in texts for w in t.split()})
    assert decontam.Templates([]).forms[0].count.tolist() == []


def test_chunks_hold_what_batches_hold():
    import pyarrow as pa

    texts = ["é" * 30, None, "", "x" * 200, "y", None]
    batch = pa.record_batch([pa.array(texts), pa.array(range(6))], ["text", "n"])
    out = [(part.column("n").to_pylist(), t) for part, t in chunks([batch, batch.slice(2, 3)], most=70)]
    assert [n for part, _ in out for n in part] == [*range(6), 2, 3, 4]
    assert [t for _, part in out for t in part] == [(t or "").encode() for t in [*texts, *texts[2:5]]]
    assert Counter(len(n) for n, _ in out)[0] == 0 and all(len(n) == len(t) for n, t in out)
