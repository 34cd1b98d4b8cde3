"""Tags and renderings of words, against plain versions, on odd rows too."""

from pyspark.sql import functions as F

from corpusloom.functions import tokens as K


def values(spark, rows, schema, column):
    """The column of every row, in the rows' order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def tags(words):
    return [t for w in words for t in ("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E" if w else "")]


def test_word_ends_undo_tags(spark):
    rows = [["ab", "c", "def"], ["", "路路x", "😀"], ["a"], [""], []]
    assert values(spark, [(r,) for r in rows], "w array<string>", K.bmes("w")) == [tags(r) for r in rows]
    ends = [[(x.begin, x.end) for x in e] for e in values(spark, [(r,) for r in rows], "w array<string>", K.word_ends(K.bmes("w")))]
    assert ends == [[(0, 2), (2, 3), (3, 6)], [(0, 3), (3, 4)], [(0, 1)], [], []]
    # a word that no tag closes is closed by the end
    assert [[(x.begin, x.end) for x in e] for e in values(spark, [(["B", "M"],), (["S", "B"],)], "t array<string>", K.word_ends("t"))] == [[(0, 2)], [(0, 1), (1, 2)]]


def test_span_f1(spark):
    from corpusloom.operators import evaluation

    rows = spark.createDataFrame([(tags(["ab", "c"]), tags(["ab", "c"])), (tags(["abc"]), tags(["a", "bc"]))], "gold array<string>, pred array<string>")
    assert {r.metric: r.value for r in evaluation.span_f1(rows).collect()} == {"precision": 0.5, "recall": 0.666667, "f1": 0.571429, "tag_accuracy": 0.666667, "exact": 0.5}


def test_bmes_valid(spark):
    rows = ["", "S", "BE", "BMMESBE", "B", "SB", "BS", "BMBE", "M", "E", "SE", "SBM"]
    get = lambda strict: [r for r, ok in zip(rows, values(spark, [(list(r),) for r in rows], "t array<string>", K.bmes_valid("t", strict))) if ok]
    assert get(True) == ["", "S", "BE", "BMMESBE"]
    assert get(False) == ["", "S", "BE", "BMMESBE", "B", "SB", "BS", "SBM"]


def test_quality_figures_of_empty_names(spark, tmp_path):
    from corpusloom.plans import catalog, serving  # noqa: F401

    names = ["hot bolt", "", None, "a", "red ring", "big nut", "x y", "", "a"]
    keys = [1, 2, 3, 4, 11, 13, 14, 7, 21]  # every 7th loses a tag, of a name that may have none
    spark.createDataFrame(list(zip(keys, names)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["e12_quality_figures"](spark, str(tmp_path)).first().asDict()
    assert got == {"n": 9, "has_seg": 5, "has_pos": 6, "length_ok": 4, "bmes_ok": 4, "pos_consistent": 3, "pos_inconsistent": 1}


def test_slash_format(spark):
    rows = [(["ab", "c"], ["N", "V"]), (["a/b"], ["X"]), ([""], ["S"]), ([], [])]
    assert values(spark, rows, "w array<string>, t array<string>", K.slash_format("w", "t")) == ["ab/N#c/V", "a/b/X", "/S", ""]


def test_headword_parts(spark):
    rows = ["a||b|c", " |x", "", "|", "one", "路|径 ", None]
    got = [(x.joined, x.parts) for x in values(spark, [(r,) for r in rows], "h string", K.headword_parts(F.col("h")))]
    assert got == [("abc", ["a", "b", "c"]), ("x", ["x"]), ("", []), ("", []), ("one", ["one"]), ("路径 ", ["路", "径 "]), (None, None)]


def test_char_tags(spark):
    rows = [(["ab", "c", "d"], "vn"), (["ab", "c"], "X"), (["", "路x"], "vn"), ([""], "N"), ([], "vn")]
    assert values(spark, rows, "s array<string>, t string", K.char_tags(F.col("s"), F.col("t"))) == [list("VVNN"), list("XXX"), list("NN"), [], []]


def test_candidate_lines(spark, tmp_path):
    from corpusloom.plans import catalog, datasets  # noqa: F401

    parts = [(i, "b1", f"n{i}", "t") for i in range(30, 5, -1)] + [(1, "b2", None, "t"), (2, "b2", "n", None), (3, "b3", None, "t"), (4, "b3", "n|", ""), (5, None, "x", "y")]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_brand: r.lines for r in catalog.QUERIES["f34_candidate_lines"](spark, str(tmp_path)).collect()}
    # as in SQL a line with a null is none, and a brand without a line has null
    assert got == {"b1": "\n".join(f"ID:{i} | n{i} | t" for i in range(6, 26)), "b2": None, "b3": "ID:4 | n| | ", None: "ID:5 | x | y"}


def test_replace_terms_longest_first(spark):
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("the", "THE"), ("and", "&"), ("then", "and"))])
    rows = ["thethen", "then the", "band", "", "路the", None]
    # what a longer key left is replaced by a shorter one
    assert values(spark, [(r,) for r in rows], "t string", K.replace_terms(F.col("t"), pairs)) == ["THE&", "& THE", "b&", "", "路THE", None]


def test_final_render(spark):
    rows = [("词项", ["开心", "高兴"]), ("动作短语", ["吃"]), (None, []), ("词项", None)]
    assert values(spark, rows, "k string, w array<string>", K.final_render("k", "w")) == ["【单词】\n开心,高兴", "【短语】\n吃", "【短语】\n", None]


def test_explanatory_keywords_are_a_violation(spark):
    from corpusloom.operators import labels

    rows = [("问", "问", "词项", "", "", ["解释"]), ("问", "解释", "词项", "", "", ["开心"]), ("问", "问", "x", "", "", ["说", "明"]), ("", "", "动作短语", "", "", None), ("", "", "动作短语", "", "", ["说明", "说明"])]
    got = values(spark, rows, "query string, core_text string, type string, predicate string, object string, keywords array<string>", labels.violations())
    assert got == [["explanatory_text"], [], ["invalid_type"], ["keywords_not_list"], ["duplicate_keyword", "empty_core_text", "empty_query", "explanatory_text", "missing_predicate"]]
