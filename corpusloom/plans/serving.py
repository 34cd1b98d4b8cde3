"""Registered queries of sources, serving and search by grams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import phonemes, tokens
from ..operators import corpus, diagnosis, grams
from ..sources import responder
from ..sources.versioned import VersionedTable
from ..streaming import windows
from .catalog import query, table
from .session import folder

# -- remote model ---------------------------------------------------------------

MODELS = ("first", "second")
#: md5 of batch, model and attempt decides what a call gives: 0-9 an error, a-b a blank text
OUTCOME = "substr(md5(concat(batch_index, ':', model, ':', attempt)), 1, 1)"


def _conversation_requests(spark, sf, size=8):
    turns = table(spark, sf, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", F.col("text").alias("query"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source"))
    made = responder.batches(turns, ["conv_id", "turn"], size)
    tries = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("attempt")) for m in MODELS for a in range(3)])
    each = made.select("*", F.explode(tries).alias("t")).select("*", "t.model", "t.attempt").withColumn("o", F.expr(OUTCOME))
    text = F.when(F.col("o").isin("a", "b"), "  ").otherwise(F.concat("model", F.lit(":"), F.col("attempt").cast("string"), F.lit(":"), F.element_at("batch_queries", -1)))
    failed = F.col("o") < "a"
    reply = F.struct("model", "attempt", F.when(~failed, text).alias("text"), F.when(failed, F.concat(F.lit("status "), "o")).alias("error"))
    return each.groupBy("batch_index").agg(F.first("batch_queries").alias("batch_queries"), F.first("batch_sources").alias("batch_sources"), F.collect_list(reply).alias("replies"))


@query(
    "s20_responder",
    """WITH u AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM conversations WHERE role = 'user' AND text IS NOT NULL),
 b AS (SELECT n // 8 AS batch_index, count(*) AS queries, arg_max(text, n) AS last_text FROM u GROUP BY n // 8),
 c AS (SELECT b.*, m.model, m.tier, a.attempt, substr(md5(concat(batch_index, ':', model, ':', attempt)), 1, 1) AS o FROM b, (VALUES ('first', 0), ('second', 1)) m(model, tier), (SELECT unnest([0, 1, 2]) AS attempt) a),
 t AS (SELECT batch_index, queries, last_text, model, tier, min(CASE WHEN o >= 'a' THEN attempt END) AS hit, arg_max(o, attempt) AS last_o FROM c GROUP BY ALL),
 r AS (SELECT t.*, coalesce(hit + 1, 3) AS calls, CASE coalesce(hit, 2) WHEN 0 THEN 0.0 WHEN 1 THEN 1.5 ELSE 4.5 END AS waited, c.o AS hit_o FROM t LEFT JOIN c ON c.batch_index = t.batch_index AND c.model = t.model AND c.attempt = t.hit),
 p AS (SELECT * FROM r WHERE tier = 0), s AS (SELECT * FROM r WHERE tier = 1),
 x AS (SELECT p.batch_index, p.queries, p.last_text, p.hit IS NOT NULL AND p.hit_o NOT IN ('a', 'b') AS ok1, s.hit IS NOT NULL AND s.hit_o NOT IN ('a', 'b') AS ok2, p.hit AS h1, s.hit AS h2, p.calls AS c1, s.calls AS c2, p.waited AS w1, s.waited AS w2, CASE WHEN p.hit = 0 THEN NULL WHEN p.hit IS NULL THEN p.last_o ELSE (SELECT o FROM c WHERE c.batch_index = p.batch_index AND c.model = 'first' AND c.attempt = p.hit - 1) END AS e1,
  CASE WHEN s.hit = 0 THEN NULL WHEN s.hit IS NULL THEN s.last_o ELSE (SELECT o FROM c WHERE c.batch_index = s.batch_index AND c.model = 'second' AND c.attempt = s.hit - 1) END AS e2 FROM p JOIN s USING (batch_index))
 SELECT batch_index, queries, CASE WHEN ok1 THEN 'first' WHEN h2 IS NOT NULL THEN 'second' ELSE 'first' END AS teacher_model, CASE WHEN ok1 THEN 'first:' || h1 || ':' || last_text WHEN ok2 THEN 'second:' || h2 || ':' || last_text END AS raw_response,
  CASE WHEN ok1 OR ok2 THEN NULL ELSE coalesce('RuntimeError: status ' || coalesce(e2, e1), 'teacher_response_has_no_text') END AS error, (c1 + CASE WHEN ok1 THEN 0 ELSE c2 END)::INT AS calls, (w1 + CASE WHEN ok1 THEN 0 ELSE w2 END)::DOUBLE AS waited_s FROM x""",
)
def s20(spark, sf):
    base = f"{folder(spark)}/responder-{uuid.uuid4().hex}"
    responder.make_ledger(_conversation_requests(spark, sf), f"{base}/ledger")
    stream = responder.answers(spark, f"{base}/ledger", f"{base}/out", f"{base}/checkpoint", model=MODELS[0], fallback_model=MODELS[1], pace="0")
    stream.awaitTermination()
    out = spark.read.schema(responder.DDL).parquet(f"{base}/out")
    return out.select("batch_index", F.size("batch_queries").cast("long").alias("queries"), "teacher_model", "raw_response", "error", "calls", "waited_s")


# -- versions of an index ----------------------------------------------------------


@query(
    "x04_patched_index",
    """WITH e AS (SELECT p_partkey, p_name || ' ' || p_size AS headword, p_type AS definition, p_partkey % 3 AS part FROM part), z AS (SELECT *, row_number() OVER (PARTITION BY headword ORDER BY part, p_partkey) AS r FROM e WHERE part > 0 AND headword NOT IN (SELECT headword FROM e WHERE part = 0)),
 m AS (SELECT max(p_partkey) AS top FROM e WHERE part = 0) SELECT p_partkey AS id, headword, definition FROM e WHERE part = 0
 UNION ALL SELECT top + row_number() OVER (ORDER BY part, p_partkey, headword), headword, definition FROM z, m WHERE r = 1""",
)
def x04(spark, sf):
    entries = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("headword"), F.col("p_type").alias("definition"), (F.col("p_partkey") % 3).alias("part"))
    index = VersionedTable(spark, f"{folder(spark)}/index-{uuid.uuid4().hex}")
    index.rebuild(entries.where("part = 0").select(F.col("ord").alias("id"), "headword", "definition"))
    for number in (1, 2):
        index.patch(entries.where(F.col("part") == number).drop("part"), batch=f"part/{number}")
    return index.read()


# -- search by grams ---------------------------------------------------------------

SPLIT = "[，。、“”‘’；：？！,\\s/()（）.]+"


@query(
    "t23_keyword_filter",
    """WITH q AS (SELECT item_id AS qid, list_filter(regexp_split_to_array(text, '[，。、“”‘’；：？！,\\s/()（）.]+'), lambda x: length(x) >= 12)[1:4] AS keywords FROM benchmark), t AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations),
 k AS (SELECT DISTINCT qid, id FROM (SELECT qid, unnest(keywords) AS w FROM q) JOIN t ON contains(text, w) UNION ALL SELECT qid, id FROM q, (SELECT id FROM t ORDER BY id LIMIT 20) WHERE len(keywords) = 0)
 SELECT qid, id, rk FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS rk FROM k) WHERE rk <= 20""",
)
def t23(spark, sf):
    words = F.filter(F.split("text", SPLIT), lambda w: F.length(w) >= 12)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.slice(words, 1, 4).alias("keywords"))
    turn = F.col("conv_id") * 1000 + F.col("turn")
    return grams.keyword_filter(asked, table(spark, sf, "conversations").select(turn.alias("id"), turn.alias("ord"), "text"))


# -- event time ---------------------------------------------------------------------


@query(
    "x06_sessions",
    """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
 SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
)
def x06(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "ts", ["user_id"], "2 hours", "value")


@query(
    "x07_sliding_windows",
    """WITH e AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 30 MINUTE]) AS window_start FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL) SELECT event_type, window_start, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL""",
)
def x07(spark, sf):
    return windows.windows(table(spark, sf, "events"), "ts", ["event_type"], "1 hour", "30 minutes", "value")


# -- text and quality ------------------------------------------------------------------

SQL_SYMBOLS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in phonemes.SYMBOLS.items()) + "}"
SQL_NAMES = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(
    "f38_phonemes",
    f"""WITH w AS (SELECT p_partkey AS id, [{SQL_NAMES(phonemes.INITIALS)}[p_partkey % 27 + 1] || {SQL_NAMES(phonemes.FINALS)}[p_partkey // 27 % {len(phonemes.FINALS)} + 1] || p_size % 6 || {SQL_NAMES(phonemes.FINALS)}[p_size + 1] || '5', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) || p_size] AS ws FROM part),
 x AS (SELECT id, i, ws[i] AS w, regexp_extract_all(ws[i], '{phonemes.SYLLABLE}', 1) AS a, regexp_extract_all(ws[i], '{phonemes.SYLLABLE}', 2) AS b, regexp_extract_all(ws[i], '{phonemes.SYLLABLE}', 3) AS c FROM w, (SELECT unnest([1, 2, 3]) AS i)),
 y AS (SELECT id, i, CASE WHEN len(b) = 0 THEN w ELSE array_to_string(list_transform(list_filter(flatten(list_transform(range(1, len(b) + 1), lambda j: [a[j], b[j], c[j]])), lambda p: p IS NOT NULL AND p <> ''), lambda p: coalesce({SQL_SYMBOLS}[p], p)), ' ') END AS t FROM x)
 SELECT id, string_agg(t, ' ' ORDER BY i) AS symbols FROM y GROUP BY id""",
)
def f38(spark, sf):
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    first = F.concat(pick(phonemes.INITIALS, key % 27), pick(phonemes.FINALS, F.floor(key / 27) % len(phonemes.FINALS)), (size % 6).cast("string"), pick(phonemes.FINALS, size), F.lit("5"))
    name = F.split("p_name", " ")
    text = F.concat_ws(" ", first, name[0], F.concat(name[1], size.cast("string")))
    return table(spark, sf, "part").select(key.alias("id"), phonemes.phonemes(text).alias("symbols"))


def _tagged(spark, sf):
    """Part names as words; every 7th lost a tag, every 11th begins wrongly, the
    types of every 13th change inside a word."""
    words = F.split("p_name", " ")
    key = F.col("p_partkey")
    tags = tokens.bmes(words)
    tags = F.when(key % 7 == 0, F.slice(tags, 1, F.greatest(F.size(tags) - 1, F.lit(0)))).otherwise(tags)
    tags = F.when(key % 11 == 0, F.concat(F.array(F.lit("E")), F.slice(tags, 2, F.size(tags)))).otherwise(tags)
    kinds = F.flatten(F.transform(words, lambda w, i: F.array_repeat(F.when(i == 0, "A").otherwise("N"), F.length(w))))
    kinds = F.when(key % 13 == 0, F.concat(F.array(F.lit("V")), F.slice(kinds, 2, F.size(kinds)))).otherwise(kinds)
    return table(spark, sf, "part").select(key.alias("id"), F.array_join(words, " ").alias("text"), tags.alias("seg_tags"), kinds.alias("pos_tags"))


@query(
    "e12_quality_figures",
    """WITH w AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS ws FROM part), c AS (SELECT k, len(array_to_string(ws, '')) AS n, (len(ws[1]) > 1)::INT AS wide FROM w), f AS (SELECT *, k % 7 <> 0 AS length_ok, k % 7 <> 0 AND k % 11 <> 0 AS bmes_ok FROM c)
 SELECT count(*) AS n, count(*) AS has_seg, count(*) AS has_pos, count(*) FILTER (length_ok) AS length_ok, count(*) FILTER (bmes_ok) AS bmes_ok, count(*) FILTER (length_ok AND (k % 13 <> 0 OR k % 11 = 0)) AS pos_consistent, count(*) FILTER (length_ok AND k % 13 = 0 AND k % 11 <> 0) AS pos_inconsistent FROM f""",
)
def e12(spark, sf):
    rows, seen = diagnosis.observed(_tagged(spark, sf))
    rows.write.parquet(f"{folder(spark)}/checked-{uuid.uuid4().hex}")
    return spark.createDataFrame([tuple(seen.get.values())], ", ".join(f"{k} bigint" for k in seen.get))
