"""The whole search over a table of queries.

Variants, dialect and negation forms, three retrievers, short-variant boost,
weighted fusion, field match and the final re-ranking, as joins keyed by qid.
The embedding is a parameter; the default is a deterministic hashed n-gram
vector, a stand-in where no model is at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..plans.session import shared
from . import retrieval as R

DIM = 64


def hashed_vector(text) -> Column:
    """R26 stand-in: counts of hashed 1- and 2-grams with signs, length one."""
    grams = F.concat(K.ngrams(text, 1), K.ngrams(text, 2))
    cells = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(2 * DIM)))
    vector = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda d: (F.size(F.filter(cells, lambda c: c == 2 * d)) - F.size(F.filter(cells, lambda c: c == 2 * d + 1))).cast("double"))
    return R.unit(vector)


def variant_rows(queries: DataFrame) -> DataFrame:
    """qid, ord, variant, dense: own variants first (dense), then the dialect
    and negation forms of the first two (lexical and sparse only)."""
    own = shared(K.with_query_variants(queries.select("qid", "text"), "text", "own").select("qid", "own"))
    more = F.flatten(F.transform(F.slice("own", 1, 2), lambda v: F.concat(K.dialect_variants(v), K.negations(v))))
    every = own.select("qid", F.size("own").alias("n"), F.array_distinct(F.concat("own", more)).alias("all"))
    every = shared(every)
    return every.select("qid", "n", F.posexplode("all").alias("ord", "variant")).select("qid", "ord", "variant", (F.col("ord") < F.col("n")).alias("dense"))


def search(queries: DataFrame, entries: DataFrame, top_k: int = 20, top_n: int = 3, embed: Callable[[str], Column] = hashed_vector) -> DataFrame:
    """Best ``top_n`` entries of every query: qid, rk, id, score.

    ``queries``: qid, text; ``entries``: id, headword, definition.
    """
    wide, fused_n, near_k = max(8 * top_n, 30), max(8 * top_n, 24), max(top_k, 50)
    forms = variant_rows(queries)
    lexical = R.lexical_fast(forms.select("qid", "ord", "variant"), entries, wide)
    index = R.Index(entries, K.sparse_tokens(F.concat(T.index_text("headword", "definition"))))
    tokens = forms.select("qid", "ord", F.explode(K.significant(K.sparse_tokens("variant"))).alias("token"))
    sparse = R.bm25_multi(index, tokens, wide)
    vectors = entries.select("id", embed(T.index_text("headword", "definition")).alias("v"))
    asked = forms.where("dense").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("ord", embed(F.col("variant")).alias("v")))).alias("x"))
    asked = asked.select("qid", R.weighted_mean(F.transform("x", lambda s: s["v"])).alias("qv"))
    near = R.dense_topk(asked, vectors, near_k)
    short = forms.where(F.col("dense") & F.length("variant").between(2, 4) & (F.col("ord") > 0) & (F.col("ord") <= 3)).select("qid", "ord", embed(F.col("variant")).alias("qv"))
    short_hits = vectors.crossJoin(short).select("qid", "id", F.round(R.dot("qv", "v"), 6).alias("score")).groupBy("qid", "id").agg(F.max("score").alias("score"))
    dense = R.short_boost(near.select("qid", "id", "rk"), R.top(short_hits, min(top_k // 2, 10), ["qid"]).select("qid", "id", "rk"))
    lists = lexical.select("qid", "id", "rk", F.lit("lexical").alias("src")).unionByName(sparse.select("qid", "id", "rk", F.lit("sparse").alias("src"))).unionByName(dense)
    fused = R.fuse(lists, fused_n).select("qid", "id", F.col("score").alias("fused"))
    variants = forms.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "variant"))), lambda s: s["variant"]).alias("variants"))
    rows = fused.join(R.field_entries(entries), "id").join(vectors, "id").join(asked, "qid").join(R.field_queries(variants), "qid")
    rows = rows.select("qid", "id", "fused", R.dot("qv", "v").alias("dense"), R.field_score().alias("field"))
    return R.final_rerank(rows, top_n).select("qid", "rk", "id", "score")
