"""Rows without an id, with the same id, and with columns of clashing names."""

import pytest

from corpusloom.llm import decontam, katz, simhash

ITEM = "What is the sum of three plain numbers that were written on the old wooden board last week"


def test_fingerprints_are_the_nodes(spark, monkeypatch):
    prints = [(1, 0b0), (None, 0b11), (3, 0b1111), (7, 255 << 40), (7, 0b111100000000000000000000), (8, 254 << 40), (9, 0b111100000000000000000011), (None, 7 << 50)]
    table = spark.createDataFrame(prints, "doc_id long, fingerprint long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: table)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table).collect()), key=str)
    # 1 - null - 3 by links of two bits; the id 7 stands in two groups that stay apart
    want = {0b0: 1, 0b11: 1, 0b1111: 1, 255 << 40: 7, 254 << 40: 7, 0b111100000000000000000000: 7, 0b111100000000000000000011: 7, 7 << 50: None}
    assert got == sorted(((i, f, want[f]) for i, f in prints), key=str)


def test_decontamination_rows(spark):
    rows = [(7, f"Some text. {ITEM} and more.", "x", 1), (7, "quite another text about a river and its boats in the long summer", "x", 2), (None, f"Again {ITEM} at the end.", "y", 3), (None, "nothing to see in these clean words about gardens", "y", 4), (8, None, "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _bad string, item_id int")
    bench = spark.createDataFrame([(None, ITEM), (2, None)], "item_id long, text string")
    found = decontam.find(docs, bench).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["exact"]) for r in found), key=str) == [(7, None, True), (None, None, True)]
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == [2, 4, 5]


def test_near_copies_keep_clashing_columns(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (None, "other words here", "c")], "doc_id long, text string, _near_row string")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["_near_row"] for r in kept.collect()) == ["a", "c"]


@pytest.mark.parametrize("name", ["_block", "score", "block", "n_tokens"])
def test_language_model_keeps_clashing_columns(spark, name):
    docs = spark.createDataFrame([(1, "a b c", True, "p"), (None, "a b", True, "q"), (3, None, False, "r")], f"doc_id long, text string, learn boolean, {name} string")
    _, out = katz.fit_and_score(docs)
    rows = out.collect()
    assert len(rows) == 3 and sorted(r[f"{name}_given"] for r in rows) == ["p", "q", "r"]
    assert all(isinstance(r["score"], float) for r in rows)
