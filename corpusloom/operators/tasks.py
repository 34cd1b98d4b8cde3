"""Retrieval tasks and legacy labels, each matched to dictionary entries.

Ties are broken by the entry's number and random choices are made in the order
of an md5, so results repeat on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..plans.session import shared, sized
from .corpus import first_of_equal, hash_order
from .grams import keyword_filter, keyword_split


def dialect_keywords(keywords) -> Column:
    """the variants of every keyword in turn, distinct; null gives none."""
    return F.array_distinct(F.flatten(F.transform(F.coalesce(K._col(keywords), K.nothing()), K.dialect_variants)))


def candidate_terms(core, segments, keywords, message) -> Column:
    """core, segments, keywords and the normalised message, trimmed, those
    with text, distinct in this order."""
    every = F.concat(F.array(core), F.coalesce(segments, K.nothing()), F.coalesce(keywords, K.nothing()))
    tidy = F.concat(F.transform(every, lambda t: F.trim(F.coalesce(t, F.lit("")))), F.array(K.normalize_search(message)))
    return F.array_distinct(F.filter(tidy, lambda t: t.isNotNull() & (t != "")))


MOST_GRAMS, MOST_POSTED = 8, 200  # fixed values: grams of a term, entries of a gram


def best_matches(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rid, id of each row's entry. ``rows``: rid, terms; ``items``: id,
    headword, definition.

    A term that equals a headword, else a definition, decides (earlier terms
    first, then the smallest id). Else entries that share one of a term's
    ``MOST_GRAMS`` longest grams (1 to 3 characters; a gram stands for its first
    ``MOST_POSTED`` entries, as the operator is defined) are scored: 20 for an
    equal headword, 8 for one that contains the term, 12 and 4 for definitions.
    Rows without a match have no row; blank and null terms match nothing.
    """
    terms = shared(rows.select("rid", F.posexplode("terms").alias("pos", "term")).where("term <> ''"))
    keys = items.select("id", F.explode(F.array(F.struct(F.col("headword").alias("term"), F.lit(0).alias("tier")), F.struct(F.col("definition").alias("term"), F.lit(1).alias("tier")))).alias("k")).select("id", "k.term", "k.tier")
    # of equal fields the smallest id decides
    keys = keys.groupBy("term", "tier").agg(F.min("id").alias("id"))
    exact = shared(terms.join(keys, "term").groupBy("rid").agg(F.min(F.struct("pos", "tier", "id")).alias("m")).select("rid", F.col("m.id").alias("id")))
    # rows of the same terms have the same entry, which is looked for once
    open_ = terms.join(exact.select("rid"), "rid", "left_anti").groupBy("rid").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    open_ = shared(open_)
    kinds = shared(open_.groupBy("terms").agg(F.min("rid").alias("kind")))
    wanted = kinds.select("kind", F.explode("terms").alias("term"))
    longest = lambda g: F.struct((-F.length(g)).alias("n"), g.alias("g"))
    gram = F.explode(F.slice(F.array_sort(F.transform(K.gram_set("term"), longest)), 1, MOST_GRAMS)).alias("x")
    asked = wanted.select("kind", gram).select("kind", F.col("x.g").alias("gram")).distinct()
    # of equal entries the first are enough
    posted = first_of_equal(items, MOST_POSTED, ["headword", "definition"]).select("id", F.explode(F.array_union(K.gram_set("headword"), K.gram_set("definition"))).alias("gram")).join(sized(asked.select("gram").distinct()), "gram", "left_semi")
    first = posted.withColumn("r", F.row_number().over(Window.partitionBy("gram").orderBy("id"))).where(F.col("r") <= MOST_POSTED).select("gram", "id")
    pairs = asked.join(first, "gram").select("kind", "id").distinct()
    inside = lambda field, same, part: F.when(F.col("term") == F.col(field), same).when(F.contains(F.col(field), F.col("term")), part).otherwise(0)
    scored = pairs.join(items, "id").join(wanted, "kind").groupBy("kind", "id").agg(F.sum(inside("headword", 20, 8) + inside("definition", 12, 4)).alias("score")).where("score > 0")
    best = scored.groupBy("kind").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"))
    return exact.unionByName(open_.join(kinds.join(best, "kind"), "terms").select("rid", "id"))


def routed(rows: DataFrame, items: DataFrame, whole_groups: bool = False) -> DataFrame:
    """Rid, id, headword, part of the matched rows. ``rows``: rid, terms,
    split. Rows of dev and test stay there, others go by the hash of their
    headword. With ``whole_groups`` all rows of a headword follow its test or
    dev row if it has one, so no headword stands on both sides."""
    found = best_matches(rows, items).join(items.select("id", "headword"), "id").join(rows.select("rid", "split"), "rid")
    fixed = F.when(F.col("split").isin("dev", "test"), F.col("split"))
    if whole_groups:
        # one row a headword, not a window over its rows; test comes before dev
        found = shared(found)
        own = found.groupBy("headword").agg(F.max(fixed).alias("own"))
        found, fixed = found.join(own, "headword"), F.col("own")
    return found.select("rid", "id", "headword", F.coalesce(fixed, K.split_name("headword")).alias("part"))


def recall_tasks(anchors: DataFrame, entries: DataFrame, most: int = 20, seed: str = "42") -> DataFrame:
    """P10: task_id, user_query, keywords, candidate ids of every anchor.

    ``anchors``: task_id, id; ``entries``: id, headword, definition. The query is
    the anchor's definition or headword (by hash). Candidates are the first
    ``most`` entries whose definition contains one of its keywords, or ``most``
    entries by hash where there are none; the anchor is put in front if it is
    not among them, and the list is shuffled by hash."""
    base = anchors.join(entries, "id").select("task_id", F.col("id").alias("anchor"), F.trim(F.when(F.substring(hash_order("task_id", seed), 1, 1) < "8", F.col("definition")).otherwise(F.col("headword"))).alias("user_query"))
    base = shared(base.withColumn("keywords", keyword_split("user_query")))
    texts = entries.select("id", F.col("id").alias("ord"), F.col("definition").alias("text"))
    hits = keyword_filter(base.select(F.col("task_id").alias("qid"), "keywords"), texts, most).select(F.col("qid").alias("task_id"), "id", "rk")
    fill = entries.select("id").orderBy(hash_order("id", seed), "id").limit(most).withColumn("rk", F.row_number().over(Window.orderBy(hash_order("id", seed), "id")).cast("long"))
    none = base.join(hits.select("task_id"), "task_id", "left_anti").select("task_id").join(F.broadcast(fill))  # ``most`` rows
    listed = hits.unionByName(none.select("task_id", "id", "rk")).groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rk", "id"))), lambda x: x["id"]).alias("ids"))
    both = base.join(listed, "task_id")
    ids = F.slice(F.when(F.array_contains("ids", F.col("anchor")), F.col("ids")).otherwise(F.concat(F.array("anchor"), "ids")), 1, most)
    mixed = lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col("task_id").cast("string"), i.cast("string")).cast("binary")).alias("h"), i.alias("i"))
    return both.select("task_id", "anchor", "user_query", "keywords", F.transform(F.array_sort(F.transform(ids, mixed)), lambda x: x["i"]).alias("candidates"))
