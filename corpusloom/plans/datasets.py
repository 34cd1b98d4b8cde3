"""Registered queries of data-set building and evaluation over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import corpus, evaluation
from .catalog import query, table

FIRST = "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate%s, o_orderkey%s) AS r FROM orders) WHERE r = 1"
MD5 = "md5('42:' || %s::VARCHAR)"
DRAW = "('0x' || substr(%s, 1, 8))::BIGINT"


@query("w03_first_per_key", FIRST % ("", ""))
def w03(spark, sf):
    return corpus.first_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("w04_last_per_key", FIRST % (" DESC", " DESC"))
def w04(spark, sf):
    return corpus.last_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "u01_union_dedupe",
    "WITH u AS (SELECT 0 AS src, p_partkey AS ord, p_name AS name FROM part UNION ALL SELECT 1, doc_id, text FROM documents UNION ALL SELECT 2, item_id, text FROM benchmark) SELECT ord, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY src, ord) AS r FROM u) WHERE r = 1",
)
def u01(spark, sf):
    parts = [table(spark, sf, t).select(F.col(i).cast("long").alias("ord"), F.col(n).alias("name")) for t, i, n in (("part", "p_partkey", "p_name"), ("documents", "doc_id", "text"), ("benchmark", "item_id", "text"))]
    return corpus.union_dedupe(parts, "name", "ord")


@query("w06_numbered", "SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS n FROM customer")
def w06(spark, sf):
    return corpus.numbered(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"]).select("c_custkey", "n")


@query(
    "w08_chunks",
    "SELECT o_custkey, (o // 4)::BIGINT AS chunk, list(o_orderkey ORDER BY o) AS items FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS o FROM orders) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY o_custkey, o // 4"),
)
def w08(spark, sf):
    return corpus.chunks(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 4, "o_orderkey")


MERGE = "WITH b AS (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_size <= 30), n AS (SELECT p_partkey AS k, p_retailprice * 2 AS v FROM part WHERE p_size >= 20), m AS (SELECT coalesce(b.k, n.k) AS k, CASE WHEN n.k IS NULL THEN b.v ELSE n.v END AS v, CASE WHEN b.k IS NOT NULL AND n.k IS NOT NULL THEN 'replaced' WHEN n.k IS NOT NULL THEN 'inserted' ELSE 'base' END AS action FROM b FULL JOIN n ON b.k = n.k)"


def _merged(spark, sf):
    part = table(spark, sf, "part")
    base = part.where("p_size <= 30").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    return corpus.upsert(base, part.where("p_size >= 20").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") * 2).alias("v")), "k")


@query("j15_upsert", MERGE + " SELECT k, round(v, 4) AS v, action FROM m")
def j15(spark, sf):
    return _merged(spark, sf).withColumn("v", F.round("v", 4))


@query("a19_merge_stats", MERGE + " SELECT action, count(*) AS n FROM m GROUP BY action")
def a19(spark, sf):
    return _merged(spark, sf).groupBy("action").agg(F.count("*").alias("n"))


@query("j06_resume", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '5-LOW')")
def j06(spark, sf):
    done = table(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").groupBy("o_orderstatus").agg(F.collect_set("o_custkey").alias("keys"))
    return corpus.resume(table(spark, sf, "customer").select("c_custkey"), done, "c_custkey", "keys")


@query("j08_contains_join", "SELECT doc_id, item_id FROM documents d, benchmark b WHERE b.text <> '' AND contains(d.text, b.text)")
def j08(spark, sf):
    return corpus.contains_join_grams(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("p01_template_product", "SELECT DISTINCT replace(t, '{}', p_type) AS query FROM part, (SELECT unnest(['{}', 'what is {}', '{} or {}']) AS t)")
def p01(spark, sf):
    return corpus.template_product(table(spark, sf, "part").select(F.col("p_type").alias("item")), ["{}", "what is {}", "{} or {}"])


@query("p03_sample_exact", f"SELECT c_custkey, c_name FROM customer ORDER BY {MD5 % 'c_custkey'}, c_custkey LIMIT 50")
def p03(spark, sf):
    return corpus.sample_exact(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 50)


@query(
    "p04_stratified_test",
    f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, c_custkey) AS r FROM (SELECT c_custkey, c_mktsegment AS stratum, {MD5 % 'c_custkey'} AS h FROM customer)) SELECT c_custkey, stratum FROM r ORDER BY CASE WHEN r <= CASE stratum WHEN 'BUILDING' THEN 20 WHEN 'MACHINERY' THEN 10 ELSE 0 END THEN 0 ELSE 1 END, h, c_custkey LIMIT 60",
)
def p04(spark, sf):
    return corpus.stratified_test(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", F.col("c_mktsegment"), {"BUILDING": 20, "MACHINERY": 10}, 60).select("c_custkey", "stratum")


@query("p05_ratio_split", f"SELECT o_orderkey, CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.95 THEN 'dev' ELSE 'test' END AS part FROM (SELECT o_orderkey, {DRAW % (MD5 % 'o_orderkey')}::DOUBLE / 4294967296 AS u FROM orders)")
def p05(spark, sf):
    return corpus.ratio_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("p06_hash_split", f"SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS part FROM (SELECT doc_id, {DRAW % 'md5(text)'} % 100 AS b FROM documents)")
def p06(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.split_name("text").alias("part"))


@query(
    "p07_assemble",
    f"""WITH cand AS (SELECT DISTINCT user_id AS q FROM events), clean AS (SELECT DISTINCT o_custkey AS q FROM orders), test AS (SELECT c_custkey AS q FROM customer WHERE c_custkey % 10 = 3), hard AS (SELECT s_suppkey AS q FROM supplier),
 pool AS (SELECT q FROM clean WHERE q IN (SELECT q FROM cand) AND q NOT IN (SELECT q FROM test) UNION SELECT q FROM hard WHERE q NOT IN (SELECT q FROM test)), n AS (SELECT least(least(200, greatest(100, (count(*) * 0.05)::DOUBLE::BIGINT)), count(*)) AS dev FROM (SELECT * FROM pool)),
 r AS (SELECT q, row_number() OVER (ORDER BY {MD5 % 'q'}, q) AS r FROM pool)
 SELECT q AS query, CASE WHEN r <= (SELECT least(200, greatest(100, floor(count(*) * 0.05)), count(*)) FROM pool) THEN 'dev' ELSE 'train' END AS part FROM r UNION ALL SELECT q, 'test' FROM test UNION ALL SELECT q, 'missing' FROM cand WHERE q NOT IN (SELECT q FROM pool) AND q NOT IN (SELECT q FROM test)
 UNION ALL SELECT q, 'missing' FROM cand WHERE q IN (SELECT q FROM r WHERE r <= (SELECT least(200, greatest(100, floor(count(*) * 0.05)), count(*)) FROM pool))""",
)
def p07(spark, sf):
    key = lambda t, c: table(spark, sf, t).select(F.col(c).cast("long").alias("query"))
    return corpus.assemble(key("events", "user_id"), key("orders", "o_custkey"), key("customer", "c_custkey").where("query % 10 = 3"), key("supplier", "s_suppkey"))


@query("a06_mean_rates", "SELECT lang, count(*) AS n, round(avg((text LIKE '%the%')::INT::DOUBLE), 6) AS with_the, round(avg((length(text) > 1000)::INT::DOUBLE), 6) AS long, round(avg((source = 'src0')::INT::DOUBLE), 6) AS src0 FROM documents GROUP BY lang")
def a06(spark, sf):
    return evaluation.mean_rates(table(spark, sf, "documents"), {"with_the": F.col("text").contains("the"), "long": F.length("text") > 1000, "src0": F.col("source") == "src0"}, ["lang"])


@query("a10_value_counts", " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::VARCHAR AS value, count(*) AS n FROM orders GROUP BY {c}" for c in ("o_orderstatus", "o_orderpriority", "o_orderdate")))
def a10(spark, sf):
    return evaluation.value_counts(table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string")), ["o_orderstatus", "o_orderpriority", "o_orderdate"])


@query("a11_conditional_counts", "SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (length(text) < 200) AS short FROM documents GROUP BY source")
def a11(spark, sf):
    return evaluation.conditional_counts(table(spark, sf, "documents"), {"english": F.col("lang") == "en", "short": F.length("text") < 200}, ["source"])


@query("a18_pattern_counts", "SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[0-9]')) AS digits, count(*) FILTER (regexp_matches(text, '@')) AS at_signs, count(*) FILTER (text LIKE '%!%') AS marks FROM documents GROUP BY lang")
def a18(spark, sf):
    return evaluation.conditional_counts(table(spark, sf, "documents"), {"digits": F.col("text").rlike("[0-9]"), "at_signs": F.col("text").contains("@"), "marks": F.col("text").contains("!")}, ["lang"])


@query("a13_rank_diagnosis", "SELECT count(*) AS n, count(*) FILTER (l_linenumber <= 6) AS found, count(*) FILTER (l_linenumber <= 1) AS top_1, count(*) FILTER (l_linenumber <= 5) AS top_5, count(*) FILTER (l_linenumber <= 6) AS top_10, count(*) FILTER (l_linenumber <= 6) AS top_50 FROM lineitem")
def a13(spark, sf):
    return evaluation.rank_diagnosis(table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") <= 6, F.col("l_linenumber")).otherwise(-1).alias("rank")), "rank")


@query(
    "e11_auc",
    "WITH c AS (SELECT value AS s, count(*) FILTER (event_type = 'click') AS p, count(*) FILTER (event_type <> 'click') AS n FROM events WHERE value IS NOT NULL GROUP BY value), w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) SELECT sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, round(sum(p * (b + n / 2.0::DOUBLE)) / (sum(p) * sum(n)), 6)::DOUBLE AS auc FROM w",
)
def e11(spark, sf):
    return evaluation.auc(table(spark, sf, "events").select("value", (F.col("event_type") == "click").cast("int").alias("y")), "value", "y")


@query("u03_difference", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def u03(spark, sf):
    key = lambda t, c: table(spark, sf, t).select(F.col(c).cast("long").alias("k"))
    return key("customer", "c_custkey").join(key("orders", "o_custkey"), "k", "left_anti").join(key("events", "user_id"), "k", "left_anti")


@query("u04_intersection", "SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def u04(spark, sf):
    key = lambda t, c: table(spark, sf, t).select(F.col(c).cast("long").alias("k"))
    return key("orders", "o_custkey").intersect(key("events", "user_id"))


@query(
    "j09_contains_both_ways",
    "WITH c AS (SELECT b.item_id AS sid, d.doc_id AS kid, CASE WHEN b.text = d.text THEN 0 ELSE 1 END AS tier FROM benchmark b, documents d WHERE b.text <> '' AND d.text <> '' AND (contains(b.text, d.text) OR contains(d.text, b.text))) SELECT sid, tier, kid FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY tier, kid) AS r FROM c) WHERE r = 1",
)
def j09(spark, sf):
    sources = table(spark, sf, "benchmark").select(F.col("item_id").alias("sid"), "text")
    return corpus.match_both_ways(sources, table(spark, sf, "documents").select(F.col("doc_id").alias("kid"), "text"))


@query("p02_template_sample", "SELECT query FROM (SELECT DISTINCT replace(t, '{}', p_type) AS query FROM part, (SELECT unnest(['{}', 'what is {}', '{} or {}']) AS t)) ORDER BY md5('42:' || query), query LIMIT 10")
def p02(spark, sf):
    return corpus.random_templates(table(spark, sf, "part").select(F.col("p_type").alias("item")), ["{}", "what is {}", "{} or {}"], 10)


@query(
    "s03_notes",
    "WITH c AS (SELECT doc_id, string_split(text, ' ') AS x FROM documents), k AS (SELECT doc_id, unnest([x[1], x[5]]) AS key, x[7] AS note FROM c WHERE len(x) >= 7 AND trim(x[7]) <> '') SELECT key, arg_max(note, doc_id) AS note FROM k GROUP BY key",
)
def s03(spark, sf):
    return corpus.notes(table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("cells")), "cells", "doc_id")


@query(
    "f36_lexicon_context",
    "WITH d AS (SELECT o_custkey AS qid, o_orderpriority AS k, o_orderstatus AS h, min(o_orderkey) AS f FROM orders GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY qid, k ORDER BY f, h) AS r FROM d), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY k, r) AS n FROM r WHERE r <= 2) SELECT qid, string_agg(k || '=' || h, '; ' ORDER BY n) AS context FROM n WHERE n <= 12 GROUP BY qid",
)
def f36(spark, sf):
    return corpus.lexicon_context(table(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("keyword"), F.col("o_orderstatus").alias("headword"), F.col("o_orderkey").alias("place")))


@query("a14_array_coverage", "SELECT count(*) AS n_rows, sum(len(string_split(text, ' ')))::BIGINT AS n_items FROM documents WHERE text IS NOT NULL")
def a14(spark, sf):
    return evaluation.array_coverage(table(spark, sf, "documents").select(F.split("text", " ").alias("items")), "items")


@query("f30_headword_parts", "SELECT p_partkey, array_to_string(x, '') AS joined, array_to_string(x, '/') AS parts FROM (SELECT p_partkey, list_filter(string_split(p_brand || '||' || p_type, '|'), lambda y: trim(y) <> '') AS x FROM part)")
def f30(spark, sf):
    both = table(spark, sf, "part").select("p_partkey", K.headword_parts(F.concat("p_brand", F.lit("||"), "p_type")).alias("x"))
    return both.select("p_partkey", "x.joined", F.array_join("x.parts", "/").alias("parts"))


@query(
    "f31_char_tags",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN repeat('V', length(w[1])) || repeat('N', length(array_to_string(w, '')) - length(w[1])) ELSE repeat('X', length(array_to_string(w, ''))) END AS tags FROM (SELECT p_partkey, p_size, string_split(p_name, ' ') AS w FROM part)",
)
def f31(spark, sf):
    tag = F.when(F.col("p_size") % 2 == 0, "vn").otherwise("X")
    return table(spark, sf, "part").select("p_partkey", F.array_join(K.char_tags(F.split("p_name", " "), tag), "").alias("tags"))


@query(
    "f34_candidate_lines",
    "SELECT p_brand, string_agg('ID:' || p_partkey || ' | ' || p_name || ' | ' || p_type, chr(10) ORDER BY p_partkey) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 20 GROUP BY p_brand",
)
def f34(spark, sf):
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    top = table(spark, sf, "part").withColumn("r", rank).where("r <= 20")
    item = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("headword"), F.col("p_type").alias("definition"))
    whole = F.count(F.concat("p_name", "p_type", F.col("p_partkey").cast("string")))
    return top.groupBy("p_brand").agg(F.when(whole > 0, K.candidate_lines(F.array_sort(F.collect_list(item)))).alias("lines"))


@query("f37_replace_terms", "SELECT doc_id, md5(replace(replace(replace(text, 'then', 'THEN'), 'and', '&'), 'the', 'THE')) AS replaced FROM documents")
def f37(spark, sf):
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("the", "THE"), ("and", "&"), ("then", "THEN"))])
    return table(spark, sf, "documents").select("doc_id", F.md5(K.replace_terms(F.col("text"), pairs)).alias("replaced"))
