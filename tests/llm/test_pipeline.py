"""The pipeline as a whole: what every stage keeps, and planted documents."""

from collections import Counter, defaultdict

import corpus_pipeline


def test_stages(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    item = next(r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect() if len(r["text"].split()) > 12)
    clean = " ".join(f"gentle{i} river" for i in range(80))
    passage = "\n".join(f"shared line number {i} of a passage" for i in range(12))
    made = [(900001, clean), (900002, clean), (900003, clean + " tail"), (900004, f"Some words first. {item} Some words last."), (900005, passage), (900006, "a new start\n" + passage + "\nand an end of its own"), (900007, None)]
    extra = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in made], table.select(*corpus_pipeline.COLUMNS).schema)
    docs = table.select(*corpus_pipeline.COLUMNS)
    seen = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        if name == "toxicity":  # fitted on few documents here; the planted ones try the other stages
            docs = docs.unionByName(extra)
        seen.append({r["doc_id"]: (r["text"] if name != "packing" else None) for r in docs.collect()})
    toxic, lines, near, leaks, packed = seen
    assert set(toxic) >= set(lines) >= set(near) >= set(leaks) == set(packed)
    assert {i for i, _ in made} <= set(lines)
    assert lines[900006] == "a new start\nand an end of its own" and lines[900005] == passage
    assert 900001 in near and not {900002, 900003} & set(near)
    assert 900004 in near and 900004 not in leaks and 900001 in leaks
    assert max(Counter(t for t in near.values() if t).values()) == 1
    assert len(packed) > 0.5 * table.count()
    fill = defaultdict(int)
    for r in docs.collect():
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096
