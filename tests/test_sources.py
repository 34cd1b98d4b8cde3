import zipfile

import pytest

from corpusloom.operators.search import search
from corpusloom.sources import tables, xlsx
from corpusloom.streaming import service

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


@pytest.fixture
def book(tmp_path):
    path = tmp_path / "book.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>word</t></si><si><r><t>de</t></r><r><t>fn</t></r></si></sst>")
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet {NS}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>pos</t></is></c><c r="C1" t="s"><v>1</v></c></row>'
            '<row><c r="A2" t="inlineStr"><is><t>a|b</t></is></c><c r="C2"><v>7</v></c></row><row><c r="B3"><v>1</v></c></row></sheetData></worksheet>',
        )
        z.writestr("xl/worksheets/sheet2.xml", "<x/>")
    return str(path)


def test_xlsx(spark, book):
    df = xlsx.read_xlsx(spark, book)
    assert df.columns == ["word", "pos", "defn"]
    assert sorted(map(tuple, df.collect())) == [("", "1", ""), ("a|b", "", "7")]
    assert xlsx.read_xlsx(spark, book, book, header=False).count() == 6
    assert [xlsx.column_number(x) for x in ("A1", "Z9", "AA1", "AB7")] == [0, 25, 26, 27]


def test_text_tables(spark, tmp_path):
    lines = tmp_path / "q.txt"
    lines.write_text("﻿one\n\n  two \n", encoding="utf-8")
    assert sorted(r[0] for r in tables.read_lines(spark, str(lines)).collect()) == ["one", "two"]
    csv = tmp_path / "e.csv"
    csv.write_text('﻿entry,definition\n a ,"x ""y"""\nnan,\n', encoding="utf-8")
    got = tables.read_csv(spark, str(csv), ["entry", "definition", "notes"])
    assert sorted(map(tuple, got.collect())) == [("", "", ""), ("a", 'x "y"', "")]
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "id long, keywords array<string>")
    tables.write_jsonl(df, str(tmp_path / "j"))
    tables.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert tables.read_jsonl(spark, str(tmp_path / "j"), df.schema).count() == 4


def test_resume_and_refresh(spark, tmp_path):
    path, src = str(tmp_path / "done"), str(tmp_path / "src")
    assert not tables.exists(spark, path) and tables.stale(spark, src, path)
    spark.range(3).write.parquet(src)
    for most in (3, 5, 5):
        tables.append_new(spark.range(most).unionByName(spark.range(1)), path, "id")
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]
    assert not tables.stale(spark, src, path)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "qid long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        service.collect_new(read(), "text", str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    entries = spark.createDataFrame([("a", 10), ("b", 20)], "text string, score int")
    answer = lambda q, e: q.join(e, "text")
    service.serve(read(), entries, str(tmp_path / "served"), str(tmp_path / "c2"), answer).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "served")).selectExpr("sum(score)").first()[0] == 40
    assert callable(search)
