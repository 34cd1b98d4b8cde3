"""Model answers and annotations: parsing, cleaning and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions import words as W

# fixed values: tags that an annotation may use
TAGS = "N V A VN M Q R D P C SP AS Y FW ND I O IDM PU X".split()

# fixed values: answers for hard cases (query, core_text, type, predicate, object, keywords)
HARD_CASES = [
    ("没用", "没用", "词项", "", "", ["没用", "无用", "不中用"]),
    ("开心", "开心", "词项", "", "", ["开心", "高兴", "快乐"]),
    ("夸人帅怎么说", "夸人帅", "动作短语", "夸", "帅", ["夸", "帅"]),
    ("很累怎么说", "很累", "词项", "", "", ["累", "疲惫", "疲劳"]),
]


def json_part(text) -> Column:
    """from the first ``[`` to the last ``]`` where the text begins with
    one, else from the first ``{`` to the last ``}``; null without any."""
    x = T.strip(text)
    return T.blank_to_null(F.when(x.startswith("["), F.regexp_extract(x, "(?s)\\[.*\\]", 0)).otherwise(F.regexp_extract(x, "(?s)\\{.*\\}", 0)))


def envelope(text) -> Column:
    """the content of an answer, else its reasoning if that is JSON."""
    x = T._col(text)
    content = T.blank_to_null(F.get_json_object(x, "$.choices[0].message.content"))
    reasons = [T.blank_to_null(F.get_json_object(x, f"$.choices[0].message.{f}")) for f in ("reasoning_content", "reasoning")]
    return F.coalesce(content, *[F.when(r.rlike("^\\s*[\\[{]"), r) for r in reasons], F.lit(""))


def legacy_answer(text) -> tuple[Column, Column]:
    """type from the header line, keywords from the first CJK line."""
    lines = F.filter(F.transform(F.split(T._col(text), "\n"), T.strip), lambda x: x != "")
    kind = F.when(F.exists(lines, lambda x: F.contains(x, F.lit("单词"))), "词项").when(F.exists(lines, lambda x: F.contains(x, F.lit("短语"))), "动作短语").otherwise("")
    body = F.get(F.filter(lines, lambda x: x.rlike(T.CJK) & ~x.rlike("单词|短语")), F.lit(0))
    return kind, F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "[,，、]"), T.strip), lambda x: x != "")


def violations() -> Column:
    """Sorted distinct codes for (query, core_text, type, predicate,
    object, keywords); null keywords end the list early."""
    stop = F.array(*map(F.lit, W.RULE_STOPWORDS))
    word = lambda k: k.rlike(f"^{T.CJK}+$")
    code = lambda cond, name: F.when(cond, F.lit(name))
    kw = F.col("keywords")
    early = [
        code(~F.col("type").isin("词项", "动作短语"), "invalid_type"),
        code(F.col("core_text").rlike("怎么说|怎么讲|怎么表达|是什么意思|啥意思"), "question_shell_retained"),
        code(F.array_contains(stop, F.col("object")), "pronoun_or_stopword_object"),
        code(kw.isNull(), "keywords_not_list"),
    ]
    late = [
        code(F.exists(kw, lambda k: ~word(k)), "non_chinese_keyword"),
        code(F.exists(kw, lambda k: F.array_contains(stop, k)), "stopword_keyword"),
        code(F.size(F.array_distinct(kw)) < F.size(kw), "duplicate_keyword"),
        code(K.final_render("type", "keywords").rlike("解释|说明"), "explanatory_text"),
        code(T.strip("query") == "", "empty_query"),
        code(T.strip("core_text") == "", "empty_core_text"),
        code((F.col("type") == "动作短语") & (F.col("predicate") == ""), "missing_predicate"),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(*early), F.when(kw.isNull(), F.array().cast("array<string>")).otherwise(F.array(*late))))))


def cleaned_answers(df: DataFrame) -> DataFrame:
    """Normalised fields of (qid, query, core_text, type, predicate,
    object, keywords), with ``errors``."""
    stop = F.array(*map(F.lit, W.RULE_STOPWORDS))
    core = T.normalize_rules(F.coalesce(T.blank_to_null("core_text"), F.col("query")))
    special = F.col("core").isin(*W.SPECIAL_WORDS)
    base = df.withColumn("core", core)
    base = base.withColumn("kind", F.when(special, "词项").otherwise(T.strip("type"))).withColumn("pred", F.when(special, "").otherwise(T.strip("predicate"))).withColumn("obj", F.when(special | F.array_contains(stop, T.strip("object")), "").otherwise(T.strip("object")))
    tidy = F.array_distinct(F.filter(F.transform(F.coalesce("keywords", K.nothing()), lambda k: F.regexp_replace(F.coalesce(k, F.lit("")), "[^\\u4e00-\\u9fff]", "")), lambda k: (k != "") & ~F.array_contains(stop, k)))
    base = base.withColumn("kw", tidy)
    ok = lambda c: F.col(c).rlike(f"^{T.CJK}+$") & ~F.array_contains(stop, F.col(c))
    phrase = F.col("kind") == "动作短语"
    kw = F.when(phrase & ok("pred") & ~F.array_contains("kw", F.col("pred")), F.concat(F.array("pred"), "kw")).otherwise(F.col("kw"))
    base = base.withColumn("kw", kw)
    kw = F.when(phrase & ok("obj") & ~F.array_contains("kw", F.col("obj")), F.concat("kw", F.array("obj"))).otherwise(F.col("kw"))
    base = base.withColumn("kw", F.slice(kw, 1, 5)).withColumn("pred", F.when(phrase, F.col("pred")).otherwise("")).withColumn("obj", F.when(phrase, F.col("obj")).otherwise(""))
    errors = F.array_compact(F.array(F.when(F.col("query") == "", "empty_query"), F.when(F.col("core") == "", "empty_core_text"), F.when(~F.col("kind").isin("词项", "动作短语"), "invalid_type"), F.when(phrase & (F.col("pred") == ""), "missing_predicate"), F.when(F.size("kw") == 0, "empty_keywords")))
    return base.select("qid", F.col("core").alias("core_text"), F.col("kind").alias("type"), F.col("pred").alias("predicate"), F.col("obj").alias("object"), F.col("kw").alias("keywords"), errors.alias("errors"))


def override(query) -> Column:
    """The answer of a hard case as a struct, else null."""
    q = T.strip(query)
    answer = lambda r: F.struct(F.lit(r[1]).alias("core_text"), F.lit(r[2]).alias("type"), F.lit(r[3]).alias("predicate"), F.lit(r[4]).alias("object"), F.array(*map(F.lit, r[5])).alias("keywords"))
    out = F.when(q.rlike("夸.*帅.*怎么(说|讲|表达)"), answer(HARD_CASES[2])).when(q.rlike("(很)?累.*怎么(说|讲|表达)"), answer(HARD_CASES[3]))
    for row in HARD_CASES:
        out = F.when(q == row[0], answer(row)).otherwise(out)
    return out


def annotation_fault(expected, sentence, tokens, tags, domains) -> Column:
    """The first reason that an annotation fails, empty if none."""
    t, g, d = T._col(tokens), T._col(tags), T._col(domains)
    bad = F.filter(g, lambda x: ~x.isin(*TAGS))
    return (
        F.when(T._col(sentence) != T._col(expected), "sentence_mismatch")
        .when(t.isNull() | F.exists(t, lambda x: x.isNull()), "tokens_invalid_type")
        .when(F.exists(t, lambda x: x == ""), "tokens_contain_empty_string")
        .when(F.array_join(t, "") != T._col(expected), "tokens_do_not_reconstruct_sentence")
        .when(g.isNull() | (F.size(g) != F.size(t)), "token_tags_length_mismatch")
        .when(d.isNull() | (F.size(d) != F.size(t)), "tone_domain_ids_length_mismatch")
        .when(F.size(bad) > 0, F.concat(F.lit("invalid_tags="), F.array_join(bad, ",")))
        .when(F.exists(d, lambda x: x.isNull() | (x < 0)), "tone_domain_ids_not_nonneg_int")
        .otherwise("")
    )


ITEM = "struct<query:string,core_text:string,type:string,predicate:string,object:string,keywords:array<string>,task_id:string,ids:array<string>>"


def parsed_items(batches: DataFrame) -> DataFrame:
    """F22 on (batch_index, batch_queries, raw_response): one row an item;
    a batch that can't be parsed has one row with its ``reason``."""
    part = json_part("raw_response")
    listed = F.when(part.startswith("["), F.from_json(part, f"array<{ITEM}>")).otherwise(F.array_compact(F.array(F.from_json(part, ITEM))))
    base = batches.withColumn("part", part).withColumn("items", listed)
    fault = F.when(F.col("raw_response").isNull(), "batch_failed").when(F.col("part").isNull(), "no_json_object").when(F.col("items").isNull() | F.expr("try_parse_json(part) is null"), "parse_error")
    base = base.withColumn("reason", fault)
    safe = F.when(F.col("reason").isNull(), F.col("items"))
    return base.select("batch_index", "batch_queries", "reason", F.posexplode_outer(safe).alias("pos", "item"))


def teacher_clean(batches: DataFrame) -> DataFrame:
    """Accepted rows and rejects with their reason: batch_index, query,
    core_text, type, final_output, status. An item without a query or with a
    fault is rejected; hard cases are overridden once they are accepted."""
    from ..plans.session import shared

    items = shared(parsed_items(batches).withColumn("qid", F.monotonically_increasing_id()))
    rows = items.where("reason is null and item is not null").select("qid", "batch_index", F.coalesce(T.strip("item.query"), F.lit("")).alias("query"), *[F.coalesce(F.col(f"item.{c}"), F.lit("")).alias(c) for c in ("core_text", "type", "predicate", "object")], "item.keywords")
    asked = rows.where("query <> ''")
    cleaned = cleaned_answers(asked).join(asked.select("qid", "batch_index", "query"), "qid").withColumn("o", override("query"))
    ok = F.size("errors") == 0
    take = lambda name: F.when(ok, F.coalesce(f"o.{name}", name))
    accepted = cleaned.select("batch_index", "query", take("core_text").alias("core_text"), take("type").alias("type"), F.when(ok, K.final_render(take("type"), take("keywords"))).alias("final_output"), F.when(ok, "ok").otherwise(F.array_join("errors", ",")).alias("status"))
    none = F.lit(None).cast("string")
    reject = lambda df, query, status: df.select("batch_index", query.alias("query"), none.alias("core_text"), none.alias("type"), none.alias("final_output"), status.alias("status"))
    return accepted.unionByName(reject(rows.where("query = ''"), F.lit(""), F.lit("missing_query_in_batch_item"))).unionByName(reject(items.where("reason is not null"), none, F.col("reason")))


def teacher_labels(batches: DataFrame) -> DataFrame:
    """The ids given for each task; later batches overwrite earlier."""
    items = parsed_items(batches).where("reason is null").select("batch_index", "pos", T.strip("item.task_id").alias("task_id"), F.transform(F.filter(F.coalesce("item.ids", K.nothing()), lambda x: T.strip(x).rlike("^\\d+$")), lambda x: T.strip(x).cast("long")).alias("ids"))
    last = Window.partitionBy("task_id").orderBy(F.col("batch_index").desc(), F.col("pos").desc())
    return items.where("task_id <> ''").withColumn("r", F.row_number().over(last)).where("r = 1").select("task_id", "ids")
