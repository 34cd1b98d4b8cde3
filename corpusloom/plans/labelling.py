"""Registered queries of text rules, labels and segmentation, over the rows of
``derived``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions import words as W
from ..operators import corpus, labels, retrieval, segmentation, tasks
from .catalog import query, table
from .derived import ANSWER, BASE, CJK, D3, D5, D7, D11, K_, OBJECTS, ROWS, SPARK_ANSWER, SPARK_ROWS, SQL_ANSWER, WORDS, clean_cell, clean_query, distinct, grams_sql, gsub, joined, listed, normalize_rules, or_else, pick, shells_off, trim
from .session import shared



def rows(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey AS id", *SPARK_ROWS)


MARKUP = trim(gsub(gsub(gsub("definition", "〈[^〉]*〉"), "《[^》]*》[:：]?"), "◇.*$"))
NORMALISED = {
    "t1": or_else(shells_off(gsub(trim("message"), "^上海话[：:]\\s*"), W.SEARCH_SHELLS), trim("message")),
    "t2": or_else(shells_off(trim("message"), W.SHARED_SHELLS), trim("message")),
    "t3": normalize_rules("message"),
    "t4": clean_query("message"),
    "t5": gsub("message", "\\s+"),
    "t9": gsub(f"regexp_split_to_array(replace({gsub(trim('definition'), '〈[^〉]+〉|《[^》]+》|﹝[^﹞]+﹞')}, '～', ''), '[：:；;。丨◇]')[1]", "^[，, ]+|[，, ]+$"),
    "t10": MARKUP,
    "t11": trim(gsub("definition", "^〈[^〉]*〉")),
    "t12": clean_cell("definition"),
    "t13": or_else(clean_cell("definition"), or_else(clean_cell("message"), "''")),
    "t24": "CASE WHEN lower(word) IN ('', 'primary', 'default', 'shanghai_csv') THEN 'primary' WHEN lower(word) IN ('second', 'secondary') OR ends_with(lower(word), '_xlsx') THEN 'second' ELSE lower(word) END",
    "t32": "replace(replace(replace(replace(replace(message || '<&\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')",
}
TESTED = {
    "t14": "length(message) BETWEEN 4 AND 9",
    "t15": f"len(regexp_extract_all(message, '{CJK}')) >= greatest(1, length(message) // 2)",
    "t16": f"regexp_matches(word, '^{CJK}+$')",
    "t18": f"length(word) BETWEEN 2 AND 18 AND length(other) BETWEEN 1 AND 12 AND word <> other AND regexp_matches(word, '{CJK}') AND regexp_matches(other, '{CJK}')",
}


@query("t01_normalisers", f"SELECT id, {', '.join(f'{v} AS {n}' for n, v in (NORMALISED | TESTED).items())} FROM ({BASE})")
def t01(spark, sf):
    made = [T.normalize_search("message").alias("t1"), T.normalize_shared("message").alias("t2"), T.normalize_rules("message").alias("t3"), T.clean_query("message").alias("t4"), T.squeeze("message").alias("t5"), T.definition_pair("definition").alias("t9"), T.markup_off("definition").alias("t10"), T.leading_marker_off("definition").alias("t11"), T.clean_cell("definition").alias("t12"), T.first_filled("definition", "message").alias("t13"), T.source_alias("word").alias("t24"), T.html_escape(F.concat("message", F.lit('<&"'))).alias("t32")]
    made += [T.length_between("message", 4, 9).alias("t14"), T.chinese_like("message").alias("t15"), T.all_chinese("word").alias("t16"), T.good_pair("word", "other").alias("t18")]
    return rows(spark, sf).select("id", *made)


SQUEEZED = gsub("message", "\\s+")
CHINESE = gsub("message", "[^一-鿿]")
PARTS = f"list_filter(list_transform(regexp_split_to_array(definition, '[，。；、！？,;!?\\s：:]+'), lambda p: {trim('p')}), lambda p: length(p) >= 2)[1:4]"
AFTER_COLON = "regexp_extract(definition, '(?s)[：:](.*)$', 1)"
TERMS = {
    "f4": f"CASE WHEN length({CHINESE}) = 1 THEN [{CHINESE}] ELSE {grams_sql(CHINESE, 2)} END",
    "f5": distinct(f"flatten([{grams_sql('word', 1)}, {grams_sql('word', 2)}, {grams_sql('word', 3)}])"),
    "f6": distinct("flatten([" + ", ".join(grams_sql(SQUEEZED, n) for n in (6, 5, 4, 3, 2)) + "])"),
    "f9": f"CASE WHEN len({PARTS}) > 0 THEN {PARTS} ELSE [{trim('definition')}] END",
    "f10": distinct(f"list_filter(regexp_split_to_array(replace({MARKUP}, '～', word), '[，。；、：:;,丨\\s]+'), lambda p: regexp_matches(p, '^{CJK}{{1,8}}$') AND p <> word)") + "[1:3]",
    "f11": f"list_filter(list_transform(regexp_split_to_array({AFTER_COLON}, '[。！？丨|]'), lambda p: {trim('p')}), lambda p: length(p) >= 3 AND contains(p, replace(word, '～', '')))[1:3]",
    "f26": "flatten(list_transform([word, other], lambda s: CASE WHEN length(s) = 1 THEN ['S'] ELSE list_concat(['B'], list_concat(list_transform(range(length(s) - 2), lambda i: 'M'), ['E'])) END))",
}
SINGLE = {
    "f18": f"CASE WHEN regexp_extract(word, '(?:夸人|夸|称赞|赞)({CJK}{{1,3}})$', 1) NOT IN ('', '人', '别人', '对方') THEN regexp_extract(word, '(?:夸人|夸|称赞|赞)({CJK}{{1,3}})$', 1) END",
    "f25": "(SELECT sum(least(length(word) - length(replace(word, c, '')), length(other) - length(replace(other, c, '')))) FROM (SELECT DISTINCT unnest(string_split(word, '')) AS c))::INT",
    "f33": "word || '/N#' || other || '/V'",
}


@query("f04_terms", f"SELECT id, {', '.join(f'{listed(v)} AS {n}' for n, v in TERMS.items())}, {', '.join(f'{v} AS {n}' for n, v in SINGLE.items())} FROM ({BASE})")
def f04(spark, sf):
    pair = F.array("word", "other")
    made = {"f4": K.cjk_bigrams("message"), "f5": K.gram_set("word"), "f6": K.substrings("message"), "f9": K.split_keywords("definition"), "f10": K.definition_keywords("definition", "word"), "f11": K.examples("definition", "word"), "f26": K.bmes(pair)}
    single = {"f18": K.praise("word"), "f25": K.char_overlap("word", "other"), "f33": K.slash_format(pair, F.array(F.lit("N"), F.lit("V")))}
    return rows(spark, sf).select("id", *[F.array_join(v, "|").alias(n) for n, v in made.items()], *[v.alias(n) for n, v in single.items()])


# -- answers and annotations -------------------------------------------------------------

STOP = "[" + ", ".join(f"'{w}'" for w in W.RULE_STOPWORDS) + "]"
HAN = f"'^{CJK}+$'"
CODES = {
    "invalid_type": "type NOT IN ('词项', '动作短语')",
    "question_shell_retained": "regexp_matches(core_text, '怎么说|怎么讲|怎么表达|是什么意思|啥意思')",
    "pronoun_or_stopword_object": f"list_contains({STOP}, object)",
    "keywords_not_list": "keywords IS NULL",
    "non_chinese_keyword": f"len(list_filter(keywords, lambda k: NOT regexp_matches(k, {HAN}))) > 0",
    "stopword_keyword": f"len(list_filter(keywords, lambda k: list_contains({STOP}, k))) > 0",
    "duplicate_keyword": "len(list_distinct(keywords)) < len(keywords)",
    "explanatory_text": "regexp_matches(array_to_string(keywords, ','), '解释|说明')",
    "empty_query": "keywords IS NOT NULL AND trim(query) = ''",
    "empty_core_text": "keywords IS NOT NULL AND trim(core_text) = ''",
    "missing_predicate": "keywords IS NOT NULL AND type = '动作短语' AND predicate = ''",
}


def answers(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey AS qid", *SPARK_ANSWER)


@query("t26_violations", f"SELECT qid, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in CODES.items())}], lambda x: x IS NOT NULL)), ',') AS codes FROM (SELECT p_partkey AS qid, {SQL_ANSWER} FROM part)")
def t26(spark, sf):
    return answers(spark, sf).select("qid", F.array_join(labels.violations(), ",").alias("codes"))


SPECIAL = "(" + ", ".join(f"'{w}'" for w in W.SPECIAL_WORDS) + ")"
GOOD = f"regexp_matches(%s, {HAN}) AND NOT list_contains({STOP}, %s)"
CLEAN = f"""c AS (SELECT *, {normalize_rules("coalesce(nullif(core_text, ''), query)")} AS core FROM a),
 k AS (SELECT *, CASE WHEN core IN {SPECIAL} THEN '词项' ELSE trim(type) END AS kind, CASE WHEN core IN {SPECIAL} THEN '' ELSE trim(predicate) END AS pred, CASE WHEN core IN {SPECIAL} OR list_contains({STOP}, trim(object)) THEN '' ELSE trim(object) END AS obj,
  list_filter(list_transform(coalesce(keywords, []), lambda w: {gsub('w', '[^一-鿿]')}), lambda w: w <> '' AND NOT list_contains({STOP}, w)) AS w0 FROM c),
 d AS (SELECT *, {distinct('w0')} AS w1, kind = '动作短语' AS phrase FROM k),
 e AS (SELECT *, CASE WHEN phrase AND {GOOD % ('pred', 'pred')} AND NOT list_contains(w1, pred) THEN list_concat([pred], w1) ELSE w1 END AS w2 FROM d),
 f AS (SELECT *, (CASE WHEN phrase AND {GOOD % ('obj', 'obj')} AND NOT list_contains(w2, obj) THEN list_concat(w2, [obj]) ELSE w2 END)[1:5] AS kw FROM e),
 g AS (SELECT *, CASE WHEN phrase THEN pred ELSE '' END AS p, CASE WHEN phrase THEN obj ELSE '' END AS o, list_filter([CASE WHEN query = '' THEN 'empty_query' END, CASE WHEN core = '' THEN 'empty_core_text' END, CASE WHEN kind NOT IN ('词项', '动作短语') THEN 'invalid_type' END, CASE WHEN phrase AND pred = '' THEN 'missing_predicate' END, CASE WHEN len(kw) = 0 THEN 'empty_keywords' END], lambda x: x IS NOT NULL) AS errors FROM f)"""


@query("t27_cleaned_answers", f"WITH a AS (SELECT p_partkey AS qid, {SQL_ANSWER} FROM part), {CLEAN} SELECT qid, core AS core_text, kind AS type, p AS predicate, o AS object, array_to_string(kw, '|') AS keywords, array_to_string(errors, ',') AS errors FROM g")
def t27(spark, sf):
    return labels.cleaned_answers(answers(spark, sf)).withColumn("keywords", F.array_join("keywords", "|")).withColumn("errors", F.array_join("errors", ","))


CASES = {name: [r for r in labels.HARD_CASES if r[0] == name][0] for name in (r[0] for r in labels.HARD_CASES)}
HARD = lambda field, other: "CASE " + " ".join(f"WHEN trim(query) = '{r[0]}' THEN {field(r)}" for r in labels.HARD_CASES) + f" WHEN regexp_matches(query, '夸.*帅.*怎么(说|讲|表达)') THEN {field(labels.HARD_CASES[2])} WHEN regexp_matches(query, '(很)?累.*怎么(说|讲|表达)') THEN {field(labels.HARD_CASES[3])} ELSE {other} END"


@query(
    "p08_teacher_clean",
    f"""WITH b AS (SELECT p_partkey, p_partkey // 4 AS batch_index, trim(query) AS query, core_text, type, predicate, object, keywords FROM (SELECT p_partkey, {SQL_ANSWER} FROM part)), s AS (SELECT *, CASE batch_index % 9 WHEN 3 THEN 'batch_failed' WHEN 5 THEN 'no_json_object' WHEN 7 THEN 'parse_error' END AS reason FROM b),
 a AS (SELECT * FROM s WHERE reason IS NULL AND query <> ''), {CLEAN}
 SELECT batch_index, query, CASE WHEN len(errors) = 0 THEN {HARD(lambda r: f"'{r[1]}'", 'core')} END AS core_text, CASE WHEN len(errors) = 0 THEN {HARD(lambda r: f"'{r[2]}'", 'kind')} END AS type,
  CASE WHEN len(errors) = 0 THEN CASE WHEN {HARD(lambda r: f"'{r[2]}'", 'kind')} = '词项' THEN '【单词】' ELSE '【短语】' END || chr(10) || {HARD(lambda r: f"'{','.join(r[5])}'", "array_to_string(kw, ',')")} END AS final_output, CASE WHEN len(errors) = 0 THEN 'ok' ELSE array_to_string(errors, ',') END AS status FROM g
 UNION ALL SELECT batch_index, '', NULL, NULL, NULL, 'missing_query_in_batch_item' FROM s WHERE reason IS NULL AND query = ''
 UNION ALL SELECT DISTINCT batch_index, NULL, NULL, NULL, NULL, reason FROM s WHERE reason IS NOT NULL""",
)
def p08(spark, sf):
    made = answers(spark, sf).withColumn("batch_index", F.expr("qid div 4"))
    item = F.struct("qid", *[F.col(c) for c in ANSWER])
    batch = made.groupBy("batch_index").agg(F.sort_array(F.collect_list(item)).alias("x"))
    text = F.to_json(F.transform("x", lambda x: F.struct(*[x[c].alias(c) for c in ANSWER])))
    odd = F.col("batch_index") % 9
    raw = F.when(odd == 3, None).when(odd == 5, "no answer").when(odd == 7, F.concat(F.lit("[{"), text)).otherwise(F.concat(F.lit("["), F.substr(text, F.lit(2)), F.lit(" done")))
    return labels.teacher_clean(batch.select("batch_index", F.transform("x", lambda x: x["query"]).alias("batch_queries"), raw.alias("raw_response")))


@query(
    "t29_annotation_faults",
    """WITH w AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS ws FROM part), s AS (SELECT k, array_to_string(ws, '') AS expected, ws FROM w)
 SELECT k AS id, CASE WHEN k % 5 = 0 THEN 'sentence_mismatch' WHEN k % 7 = 0 THEN 'tokens_contain_empty_string' WHEN k % 11 = 0 THEN 'tokens_do_not_reconstruct_sentence' WHEN k % 13 = 0 THEN 'token_tags_length_mismatch' WHEN k % 17 = 0 THEN 'tone_domain_ids_length_mismatch' WHEN k % 19 = 0 THEN 'invalid_tags=Z1,z2' WHEN k % 23 = 0 THEN 'tone_domain_ids_not_nonneg_int' ELSE '' END AS fault FROM s""",
)
def t29(spark, sf):
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    expected = F.array_join(words, "")
    tokens = F.when(k % 7 == 0, F.concat(words, F.array(F.lit("")))).when(k % 11 == 0, F.concat(words, F.array(F.lit("x")))).otherwise(words)
    tags = F.when(k % 19 == 0, F.transform(tokens, lambda t, i: F.when(i == 0, "Z1").when(i == 1, "z2").otherwise("N"))).otherwise(F.transform(tokens, lambda t: F.lit("N")))
    tags = F.when(k % 13 == 0, F.concat(tags, F.array(F.lit("N")))).otherwise(tags)
    domains = F.transform(tokens, lambda t, i: F.when((k % 23 == 0) & (i == 1), -1).otherwise(i))
    domains = F.when(k % 17 == 0, F.slice(domains, 1, 1)).otherwise(domains)
    sentence = F.when(k % 5 == 0, F.concat(expected, F.lit("!"))).otherwise(expected)
    return table(spark, sf, "part").select(k.alias("id"), labels.annotation_fault(expected, sentence, tokens, tags, domains).alias("fault"))


# -- segmentation --------------------------------------------------------------------------

LEXICON_SQL = f"""r AS (SELECT id AS ord, word, tags FROM ({BASE})),
 v AS (SELECT ord, trim(replace(word, '|', '')) AS word, list_filter(list_transform(regexp_split_to_array(tags, '[+/]'), lambda t: trim(t)), lambda t: t <> '') AS ts, trim(tags) AS raw FROM r),
 y AS (SELECT ord, word, unnest(ts2) AS tag, generate_subscripts(ts2, 1) AS i FROM (SELECT ord, word, CASE WHEN len(list_filter(ts, lambda t: list_contains([{', '.join(f"'{t}'" for t in labels.TAGS)}], t))) > 0 THEN list_filter(ts, lambda t: list_contains([{', '.join(f"'{t}'" for t in labels.TAGS)}], t)) ELSE [raw] END AS ts2 FROM v WHERE word <> '' AND word <> 'nan')),
 z AS (SELECT word, tag, min(ord * 100 + i) AS place FROM y GROUP BY word, tag), lex AS (SELECT word, list(tag ORDER BY place) AS tags FROM z GROUP BY word)"""
PUNCT = segmentation.PUNCTUATION.replace("'", "''")
SENTENCE = joined(ROWS["message"], ROWS["other"], ("'，'", "'，'"), ROWS["word"])


@query("g04_lexicon", f"WITH {LEXICON_SQL} SELECT word, array_to_string(tags, ',') AS tags FROM lex")
def g04(spark, sf):
    return segmentation.load_lexicon(rows(spark, sf).select(F.col("id").alias("ord"), "word", "tags")).withColumn("tags", F.array_join("tags", ","))


@query(
    "g01_segment",
    f"""WITH RECURSIVE {LEXICON_SQL}, s AS (SELECT p_partkey AS id, {SENTENCE[1]} AS sentence FROM part), m AS (SELECT max(length(word)) AS m FROM lex),
 b AS (SELECT id, place, max(len) AS len FROM (SELECT s.id, i.place, length(l.word) AS len FROM s, unnest(range(1, length(sentence) + 1)) AS i(place), lex l WHERE NOT contains('{PUNCT}', substr(sentence, i.place, 1)) AND substr(sentence, i.place, length(l.word)) = l.word) GROUP BY id, place),
 w AS (SELECT id, 1::BIGINT AS place, 0::BIGINT AS pos FROM s UNION ALL SELECT w.id, w.place + coalesce(b.len, 1), w.pos + 1 FROM w JOIN s ON s.id = w.id LEFT JOIN b ON b.id = w.id AND b.place = w.place WHERE w.place <= length(s.sentence))
 SELECT w.id, w.pos, substr(sentence, w.place, coalesce(b.len, 1)) AS token, CASE WHEN contains('{PUNCT}', substr(sentence, w.place, 1)) THEN 'PU' ELSE coalesce(array_to_string(l.tags, ','), 'X') END AS tags
 FROM w JOIN s ON s.id = w.id LEFT JOIN b ON b.id = w.id AND b.place = w.place LEFT JOIN lex l ON l.word = substr(sentence, w.place, b.len) WHERE w.place <= length(sentence)""",
)
def g01(spark, sf):
    lexicon = shared(segmentation.load_lexicon(rows(spark, sf).select(F.col("id").alias("ord"), "word", "tags")))
    sentences = table(spark, sf, "part").selectExpr("p_partkey AS id", f"{SENTENCE[0]} AS sentence")
    return segmentation.segment(sentences, lexicon).withColumn("tags", F.array_join("tags", ","))


#: Four scores for each of 1 to 6 characters of every key.
SCORE = lambda i, j: f"((p_partkey * 7 + ({i}) * 13 + ({j}) * 29 + p_partkey * ({i}) * ({j}) % 11) % 97)"
BEST = lambda x, y, px, py: (f"CASE WHEN {x} IS NULL OR {y} > {x} THEN {y} ELSE {x} END", f"CASE WHEN {x} IS NULL OR {y} > {x} THEN {py} ELSE {px} END")
OPEN_, SHUT = BEST("b", "m", "pb", "pm"), BEST("e", "s", "pe", "ps")
FINAL = BEST("e", "s", "pe", "ps")


@query(
    "g06_viterbi",
    f"""WITH RECURSIVE v AS (SELECT p_partkey, p_partkey % 6 + 1 AS n, 1 AS i, {SCORE(1, 0)} AS b, NULL::BIGINT AS m, NULL::BIGINT AS e, {SCORE(1, 3)} AS s, 'B' AS pb, NULL::VARCHAR AS pm, NULL::VARCHAR AS pe, 'S' AS ps FROM part
 UNION ALL SELECT p_partkey, n, i + 1, {SHUT[0]} + {SCORE('i + 1', 0)}, {OPEN_[0]} + {SCORE('i + 1', 1)}, {OPEN_[0]} + {SCORE('i + 1', 2)}, {SHUT[0]} + {SCORE('i + 1', 3)}, {SHUT[1]} || 'B', {OPEN_[1]} || 'M', {OPEN_[1]} || 'E', {SHUT[1]} || 'S' FROM v WHERE i < n)
 SELECT p_partkey AS id, coalesce({FINAL[1]}, '') AS tags FROM v WHERE i = n""",
)
def g06(spark, sf):
    emissions = f"transform(sequence(1, cast(p_partkey % 6 + 1 as int)), i -> array({', '.join(SCORE('i', j) for j in range(4))}))"
    return segmentation.viterbi(table(spark, sf, "part").selectExpr("p_partkey AS id", f"{emissions} AS emissions")).withColumn("tags", F.array_join("tags", ""))


@query(
    "g07_core_span",
    f"""WITH x AS (SELECT p_partkey, {SENTENCE[1]} AS t FROM part), c AS (SELECT p_partkey, t, i, {SCORE('i', 1)} / 97.0::DOUBLE AS p FROM x, unnest(range(1, length(t) + 1)) AS r(i)),
 g AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS run FROM c WHERE p >= 0.5), s AS (SELECT p_partkey, any_value(t) AS t, min(i) AS a, max(i) AS b, sum(p) AS total FROM g GROUP BY p_partkey, run),
 m AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(total, 9) DESC, a) AS r FROM s) SELECT x.p_partkey AS id, coalesce({gsub("substr(m.t, a, b - a + 1)", "^[，。,.!！？?；;：:、]+|[，。,.!！？?；;：:、]+$")}, '') AS core FROM x LEFT JOIN m ON m.p_partkey = x.p_partkey AND r = 1""",
)
def g07(spark, sf):
    base = table(spark, sf, "part").selectExpr("p_partkey", f"{SENTENCE[0]} AS t")
    scores = f"transform(sequence(1, length(t)), i -> {SCORE('i', 1)} / 97.0D)"
    return base.selectExpr("p_partkey AS id", "t", f"{scores} AS p").select("id", segmentation.core_span("t", "p").alias("core"))


@query(
    "p09_teacher_labels",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey // 5 AS b, o_custkey % 40 AS t FROM orders), g AS (SELECT * FROM o WHERE b % 8 <> 3), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY b DESC, k DESC) AS r FROM g)
 SELECT 't' || t AS task_id, CASE WHEN k % 3 = 0 THEN '' ELSE k || ',' || (k + 7) END AS ids FROM r WHERE r = 1""",
)
def p09(spark, sf):
    made = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.expr("o_orderkey div 5").alias("b"), F.concat(F.lit(" t"), (F.col("o_custkey") % 40).cast("string")).alias("task_id"))
    ids = F.when(F.col("k") % 3 == 0, F.array(F.lit("none"))).otherwise(F.array(F.col("k").cast("string"), F.lit("x1"), (F.col("k") + 7).cast("string")))
    batch = made.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("k", "task_id", ids.alias("ids")))).alias("x"))
    text = F.to_json(F.transform("x", lambda x: F.struct(x["task_id"].alias("task_id"), x["ids"].alias("ids"))))
    raw = F.when(F.col("b") % 8 == 3, F.concat(F.lit("sorry: "), F.lit("no"))).otherwise(text)
    none = F.array().cast("array<string>").alias("batch_queries")
    return labels.teacher_labels(batch.select(F.col("b").alias("batch_index"), none, raw.alias("raw_response"))).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


# -- joins and data sets ---------------------------------------------------------------------


@query("p11_sft_messages", "SELECT conv_id, to_json(list({'role': role, 'content': text} ORDER BY turn)) AS messages FROM conversations GROUP BY conv_id")
def p11(spark, sf):
    return corpus.sft_messages(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("s16_fill_empty", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, c_mktsegment, '') AS note FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey")
def s16(spark, sf):
    base = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderstatus")).alias("note"))
    new = table(spark, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("note"))
    return corpus.fill_empty(base, new, "o_custkey", "note").select("o_orderkey", "note")


@query("p18_index_records", f"SELECT id, {or_else(clean_cell('word'), or_else(clean_cell('other'), "''"))} AS headword, {clean_cell('definition')} AS definition, {or_else(clean_cell('word'), or_else(clean_cell('other'), "''"))} || '。释义：' || {clean_cell('definition')} AS index_text FROM ({BASE}) WHERE {clean_cell('definition')} <> ''")
def p18(spark, sf):
    return corpus.index_records(rows(spark, sf).select("id", F.col("word").alias("headword"), F.col("other").alias("alternative"), "definition"))


@query("j03_notes", "WITH n AS (SELECT p_name AS key, max(p_type) AS note FROM part WHERE p_size > 25 GROUP BY p_name UNION ALL SELECT DISTINCT p_brand, 'brand' FROM part WHERE p_size <= 25) SELECT p_partkey AS id, coalesce(a.note, b.note, '') AS note FROM part LEFT JOIN n a ON a.key = p_name LEFT JOIN n b ON b.key = p_brand")
def j03(spark, sf):
    part = table(spark, sf, "part")
    named = part.where("p_size > 25").groupBy(F.col("p_name").alias("key")).agg(F.max("p_type").alias("note"))
    notes = named.unionByName(part.where("p_size <= 25").select(F.col("p_brand").alias("key"), F.lit("brand").alias("note")).distinct())
    hits = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("headword"), F.col("p_brand").alias("definition"))
    return retrieval.with_notes(hits, notes).select("id", "note")


@query("j13_labels_on_tasks", "WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey), x AS (SELECT o_orderkey, list_filter(coalesce(ids, []), lambda v: v % 3 <> o_orderkey % 3) AS f FROM orders LEFT JOIN l ON l_orderkey = o_orderkey) SELECT o_orderkey AS task_id, array_to_string((" + distinct("f") + ")[1:2], ',') AS target_ids, CASE WHEN len(f) = 0 THEN 'empty_ids' ELSE 'ok' END AS status FROM x")
def j13(spark, sf):
    given = table(spark, sf, "lineitem").where("l_quantity > 10").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    own = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), "l_partkey").where("l_partkey % 3 <> task_id % 3").groupBy("task_id").agg(F.collect_set("l_partkey").alias("candidate_ids"))
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.lit(2).alias("top_n")).join(own, "task_id", "left").withColumn("candidate_ids", F.coalesce("candidate_ids", F.array().cast("array<bigint>")))
    return corpus.labels_on_tasks(tasks, given).withColumn("target_ids", F.array_join("target_ids", ","))


@query(
    "p13_negatives",
    """WITH p AS (SELECT c_custkey AS qid, c_custkey % 100 AS id FROM customer), n AS (SELECT DISTINCT p_partkey AS neg, ('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT % 64 AS b FROM part), d AS (SELECT *, ('0x' || substr(md5('42:' || qid), 1, 8))::BIGINT % 64 AS b FROM p)
 SELECT qid, id, neg, rk FROM (SELECT qid, id, neg, row_number() OVER (PARTITION BY qid ORDER BY md5('42:' || qid || ':' || neg), neg) AS rk FROM d JOIN n USING (b) WHERE neg <> id) WHERE rk <= 7""",
)
def p13(spark, sf):
    pairs = table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") % 100).alias("id"))
    return corpus.negatives(pairs, table(spark, sf, "part").select(F.col("p_partkey").alias("id")))


@query(
    "j10_gram_match",
    f"""WITH x AS (SELECT s_suppkey AS id, s_name AS text FROM supplier), y AS (SELECT p_partkey AS id, p_name AS text FROM part), g AS (SELECT 'l' AS side, id, unnest(list_distinct(flatten([{', '.join(grams_sql('text', n) for n in (1, 2, 3))}]))) AS gram FROM x UNION ALL SELECT 'r', id, unnest(list_distinct(flatten([{', '.join(grams_sql('text', n) for n in (1, 2, 3))}]))) FROM y),
 p AS (SELECT * FROM (SELECT id, gram, row_number() OVER (PARTITION BY gram ORDER BY id) AS r FROM g WHERE side = 'r') WHERE r <= 200), s AS (SELECT g.id AS left_id, p.id, sum(length(g.gram)) AS score FROM g JOIN p USING (gram) WHERE side = 'l' GROUP BY ALL)
 SELECT left_id, id, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, id) AS r FROM s) WHERE r = 1""",
)
def j10(spark, sf):
    left = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))
    return corpus.gram_match(left, table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")))


# -- tasks and legacy labels --------------------------------------------------------------------

LEGACY = f"""i AS (SELECT p_partkey AS id, p_name || ' ' || p_size AS headword, p_type AS definition FROM part WHERE p_partkey % 2 = 0),
 r AS (SELECT p_partkey AS rid, list_filter([CASE WHEN p_partkey % 6 = 1 THEN p_name || ' ' || p_size END, split_part(p_name, ' ', 2), CASE WHEN p_partkey % 4 = 1 THEN lower(p_type) ELSE p_brand END], lambda t: t IS NOT NULL) AS terms, CASE p_partkey % 10 WHEN 7 THEN 'dev' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM part WHERE p_partkey % 2 = 1),
 t AS (SELECT rid, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM r), k AS (SELECT id, headword AS term, 0 AS tier FROM i UNION ALL SELECT id, definition, 1 FROM i),
 e AS (SELECT rid, arg_min(id, pos * 1e12 + tier * 1e10 + id) AS id FROM t JOIN k USING (term) GROUP BY rid), o AS (SELECT * FROM t WHERE rid NOT IN (SELECT rid FROM e)),
 g AS (SELECT DISTINCT rid, gram FROM (SELECT rid, gram, row_number() OVER (PARTITION BY rid, pos ORDER BY length(gram) DESC, gram) AS n FROM (SELECT rid, pos, unnest(list_distinct(flatten([{', '.join(grams_sql('term', n) for n in (1, 2, 3))}]))) AS gram FROM o)) WHERE n <= 8),
 p AS (SELECT gram, id FROM (SELECT gram, id, row_number() OVER (PARTITION BY gram ORDER BY id) AS n FROM (SELECT DISTINCT id, unnest(flatten([{', '.join(grams_sql(c, n) for c in ('headword', 'definition') for n in (1, 2, 3))}])) AS gram FROM i)) WHERE n <= 200),
 s AS (SELECT rid, id, sum(CASE WHEN term = headword THEN 20 WHEN contains(headword, term) THEN 8 ELSE 0 END + CASE WHEN term = definition THEN 12 WHEN contains(definition, term) THEN 4 ELSE 0 END) AS score FROM (SELECT DISTINCT rid, id FROM g JOIN p USING (gram)) JOIN i USING (id) JOIN o USING (rid) GROUP BY rid, id),
 b AS (SELECT rid, id FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) AS n FROM s WHERE score > 0) WHERE n = 1),
 m AS (SELECT x.rid, x.id, headword, split, CASE WHEN ('0x' || substr(md5(headword), 1, 8))::BIGINT % 100 < 80 THEN 'train' WHEN ('0x' || substr(md5(headword), 1, 8))::BIGINT % 100 < 90 THEN 'dev' ELSE 'test' END AS own FROM (SELECT * FROM e UNION ALL SELECT * FROM b) x JOIN i USING (id) JOIN r USING (rid))"""


def _legacy(spark, sf):
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    head = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    items = part.where("p_partkey % 2 = 0").select(key.alias("id"), head.alias("headword"), F.col("p_type").alias("definition"))
    terms = F.array_compact(F.array(F.when(key % 6 == 1, head), F.split("p_name", " ")[1], F.when(key % 4 == 1, F.lower("p_type")).otherwise(F.col("p_brand"))))
    return part.where("p_partkey % 2 = 1").select(key.alias("rid"), terms.alias("terms"), F.when(key % 10 == 7, "dev").when(key % 10 == 9, "test").otherwise("train").alias("split")), items


@query("p15_legacy_labels", f"WITH {LEGACY} SELECT rid, id, headword, CASE WHEN split IN ('dev', 'test') THEN split ELSE own END AS part FROM m")
def p15(spark, sf):
    return tasks.routed(*_legacy(spark, sf))


@query("p15_whole_groups", f"WITH {LEGACY} SELECT rid, id, headword, coalesce(max(CASE WHEN split IN ('dev', 'test') THEN split END) OVER (PARTITION BY headword), own) AS part FROM m")
def p15_whole(spark, sf):
    return tasks.routed(*_legacy(spark, sf), whole_groups=True)


@query(
    "p10_recall_tasks",
    """WITH e AS (SELECT p_partkey AS id, p_name AS headword, p_type || ' ' || p_brand AS definition FROM part), a AS (SELECT c_custkey AS task_id, id AS anchor, trim(CASE WHEN substr(md5('42:' || c_custkey), 1, 1) < '8' THEN definition ELSE headword END) AS user_query FROM customer JOIN e ON id = c_custkey % 2000),
 k AS (SELECT *, list_filter(regexp_split_to_array(user_query, '[，。、“”‘’；：？！,\\s/()（）]+'), lambda w: length(w) >= 2)[1:4] AS keywords FROM a), w AS (SELECT DISTINCT unnest(keywords) AS w FROM k), f AS (SELECT w, id FROM (SELECT w, id, row_number() OVER (PARTITION BY w ORDER BY id) AS n FROM w JOIN e ON contains(definition, w)) WHERE n <= 20),
 h AS (SELECT task_id, id, row_number() OVER (PARTITION BY task_id ORDER BY id) AS rk FROM (SELECT DISTINCT task_id, id FROM (SELECT task_id, unnest(keywords) AS w FROM k) JOIN f USING (w))),
 z AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS rk FROM e), c AS (SELECT * FROM h WHERE rk <= 20 UNION ALL SELECT task_id, id, rk FROM (SELECT task_id FROM k WHERE task_id NOT IN (SELECT task_id FROM h)), z WHERE rk <= 20),
 l AS (SELECT task_id, list(id ORDER BY rk) AS ids FROM c GROUP BY task_id), n AS (SELECT k.*, (CASE WHEN list_contains(ids, anchor) THEN ids ELSE list_concat([anchor], ids) END)[1:20] AS ids FROM k JOIN l USING (task_id))
 SELECT task_id, anchor, user_query, array_to_string(keywords, '|') AS keywords, (SELECT string_agg(i, ',' ORDER BY md5('42:' || task_id || ':' || i), i) FROM (SELECT unnest(ids) AS i)) AS candidates FROM n""",
)
def p10(spark, sf):
    part = table(spark, sf, "part")
    entries = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("headword"), F.concat_ws(" ", "p_type", "p_brand").alias("definition"))
    anchors = table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"), (F.col("c_custkey") % 2000).alias("id"))
    return tasks.recall_tasks(anchors, entries).withColumn("keywords", F.array_join("keywords", "|")).withColumn("candidates", F.array_join("candidates", ","))


PAIRS_SQL = [(a, b) for a, b in W.DIALECT_PAIRS]
FORMS = lambda x: "list_concat([" + x + "], list_filter([" + ", ".join(f"CASE WHEN contains({x}, '{a}') THEN replace({x}, '{a}', '{b}') END" for a, b in PAIRS_SQL) + "], lambda v: v IS NOT NULL))"


@query(
    "f15_dialect_keywords",
    f"WITH x AS (SELECT id, list_concat({FORMS('message')}, {FORMS('other')}) AS every, list_filter([trim(coalesce(CASE WHEN id % 5 = 0 THEN NULL ELSE word END, '')), trim(message), trim(other), {or_else(shells_off(gsub(trim('message'), '^上海话[：:]\\s*'), W.SEARCH_SHELLS), trim('message'))}], lambda t: t <> '') AS terms FROM ({BASE})) SELECT id, array_to_string({distinct('every')}, '|') AS forms, array_to_string({distinct('terms')}, '|') AS terms FROM x",
)
def f15(spark, sf):
    forms = tasks.dialect_keywords(F.array("message", "other"))
    terms = tasks.candidate_terms(F.when(F.col("id") % 5 != 0, F.col("word")), F.array("message"), F.array("other"), "message")
    return rows(spark, sf).select("id", F.array_join(forms, "|").alias("forms"), F.array_join(terms, "|").alias("terms"))
