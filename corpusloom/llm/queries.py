"""The registered query of each operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, html_extract, katz, langid, linededup, packing, quality, runindex, simhash, toxicity, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column, modulus: int):
    """crc32 of the number as text modulo ``modulus``; a null is in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def op1_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = fold("doc_id", 3) == 1
    model = toxicity.fit(toxicity.training_sample(docs.where(~held), labels.where(~held), 3000))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_url_filter(spark, sf_dir):
    out = url_filter.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op3_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op5_katz(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    model, out = katz.fit_and_score(docs.withColumn("learn", ~F.col("held_out")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_line_dedup(spark, sf_dir):
    out = linededup.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.length("text").cast("long").alias("n_kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op7_run_index(spark, sf_dir):
    out = runindex.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op8_decontamination(spark, sf_dir):
    out = decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "exact")


def op9_quality(spark, sf_dir):
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_html(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op11_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_language(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs.where(fold("doc_id", 4) != 2)))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op13_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_url_filter, op3_packing, op4_simhash, op5_katz, op6_line_dedup, op7_run_index, op8_decontamination, op9_quality, op10_html, op11_divergence, op12_language, op13_whitening)}

ORACLES: dict[str, str] = {
    "op11_divergence": r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
 c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
 l AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
 g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c USING (lang, source) GROUP BY ALL),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 1)) // (g.n + l.v) AS p, 1 + (1000000000 * (k.n::HUGEINT + 1)) // (l.n + l.v) AS q FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  UNION ALL SELECT x.lang, x.source, 'pair', y.source, 0 FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source WHERE x.lang NOT IN (SELECT lang FROM l)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a)
 SELECT lang, source, part, item, value::BIGINT AS value, rank FROM r WHERE part = 'pair' OR rank <= 200"""
}
