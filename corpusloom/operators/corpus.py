"""Corpus and training-set operators: dedupe, merge, split, sample, render.

Random choices are made in the order of an md5 of a seed and the row's key:
repeatable, the same on every engine, and free of driver state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K


def hash_order(key, seed: str = "42") -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), T._col(key).cast("string")).cast("binary"))


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def last_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return first_per_key(df, key, [F.col(c).desc() for c in order])


def union_dedupe(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Sources in turn; the first row of each key stays."""
    whole = None
    for number, df in enumerate(sources):
        part = df.withColumn("_src", F.lit(number))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return first_per_key(whole, [key], ["_src", order]).drop("_src")


def first_of_equal(df: DataFrame, n: int, key: list[str], order: str = "id") -> DataFrame:
    """The first n rows of every key. Rows are dealt evenly and cut in every
    task before they meet, so no task holds a table of few files or a frequent
    key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return df.repartition(order).withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def numbered(df: DataFrame, order: list[str], start: int = 0, name: str = "n") -> DataFrame:
    """Consecutive numbers over a whole table. Counts per range partition
    are added up, so no task holds all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    from ..plans.session import shared

    ranged = shared(ranged)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy("a._p").agg(F.coalesce(F.sum("b._c"), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_place", place).join(before, "_p").withColumn(name, (F.col("_before") + F.col("_place") - 1 + start).cast("long")).drop("_p", "_place", "_before")


def chunks(df: DataFrame, key: list[str], order: list[str], size: int, value: str) -> DataFrame:
    """Lists of ``size`` values within each key, in order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    cut = df.withColumn("_o", place).withColumn("chunk", F.floor(F.col("_o") / size).cast("long"))
    packed = cut.groupBy(*key, "chunk").agg(F.sort_array(F.collect_list(F.struct("_o", F.col(value).alias("x")))).alias("xs"))
    return packed.select(*key, "chunk", F.transform("xs", lambda s: s["x"]).alias("items"))


def upsert(base: DataFrame, new: DataFrame, key: str, prefer_new: bool = True) -> DataFrame:
    """Full merge by key with the action taken for each row."""
    values = [c for c in base.columns if c != key]
    b, n = base.withColumn("_b", F.lit(1)).alias("b"), new.withColumn("_n", F.lit(1)).alias("n")
    both = b.join(n, key, "full")
    old, fresh = F.col("_b").isNotNull(), F.col("_n").isNotNull()
    take = fresh & (F.lit(prefer_new) | ~old)
    action = F.when(old & fresh, F.lit("replaced" if prefer_new else "kept")).when(fresh, "inserted").otherwise("base")
    return both.select(key, *[F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in values], action.alias("action"))


def contains_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the document contains the item, by the
    items' rarest grams of characters."""
    from .grams import containing

    named = items.select("item_id", F.col("text").alias("keyword"))
    return containing(docs.select(F.col("doc_id").alias("id"), "text"), named).withColumnRenamed("id", "doc_id").join(named, "keyword").select("doc_id", "item_id")


def contains_join_grams(docs: DataFrame, items: DataFrame, words: int = 4) -> DataFrame:
    """J8 by an equi join: a document that contains an item contains its
    windows of whole words; only such pairs are compared. Items of fewer than
    ``words + 2`` words go by grams of characters, as their first and last word
    may be cut."""
    w = lambda c: F.array_remove(F.split(F.regexp_replace(c, "\\s+", " "), " "), "")
    inner = items.select("item_id", F.col("text").alias("needle"), w(F.col("text")).alias("w")).where("needle <> ''")
    long = inner.where(F.size("w") >= words + 2)
    # one window from the middle is enough: it is whole wherever the item occurs
    key = long.select("item_id", "needle", F.xxhash64(F.array_join(F.slice("w", 2, words), " ")).alias("gram"))
    here = docs.select("doc_id", "text", w(F.col("text")).alias("w")).where(F.size("w") >= words)
    grams = here.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " "))))).alias("gram"))
    pairs = grams.join(key, "gram").select("doc_id", "item_id", "needle").distinct()
    found = docs.join(pairs, "doc_id").where(F.contains("text", F.col("needle"))).select("doc_id", "item_id")
    short = inner.where(F.size("w") < words + 2).select("item_id", F.col("needle").alias("text"))
    return found.unionByName(contains_join(docs, short))


def gram_match(left: DataFrame, right: DataFrame, cap: int = 200) -> DataFrame:
    """Best right row for each left text by shared 1- to 3-grams; a gram
    counts its length; a gram's postings are its first ``cap`` ids (the cap is
    the operator's definition). Both sides: id, text."""
    from ..plans.session import shared, sized

    grams = lambda df: df.select("id", F.explode(K.gram_set("text")).alias("gram"))
    # of equal texts the first ``cap`` are enough
    posts = grams(first_of_equal(right, cap, ["text"])).withColumn("_r", F.row_number().over(Window.partitionBy("gram").orderBy("id"))).where(F.col("_r") <= cap).drop("_r")
    posts = shared(posts)
    # texts that share the same grams with the right side have the same scores,
    # which are added up once
    met = grams(left).join(sized(posts.select("gram").distinct()), "gram", "left_semi")
    sets = shared(met.groupBy(F.col("id").alias("left_id")).agg(F.sort_array(F.collect_list("gram")).alias("grams")))
    kinds = shared(sets.groupBy("grams").agg(F.min("left_id").alias("kind")))
    scored = kinds.select("kind", F.explode("grams").alias("gram")).join(posts, "gram").groupBy("kind", "id").agg(F.sum(F.length("gram")).alias("score"))
    best = scored.groupBy("kind").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("x"))
    return sets.join(kinds.join(best, "kind"), "grams").select("left_id", "x.id", "x.score")


def labels_on_tasks(tasks: DataFrame, labels: DataFrame) -> DataFrame:
    """Label ids restricted to a task's own candidates, in label order,
    the first ``top_n``."""
    both = tasks.join(labels, "task_id", "left")
    ok = F.slice(F.array_distinct(F.filter(F.coalesce("ids", F.array().cast("array<bigint>")), lambda x: F.array_contains("candidate_ids", x))), 1, F.col("top_n").cast("int"))
    return both.select("task_id", ok.alias("target_ids")).withColumn("status", F.when(F.size("target_ids") == 0, "empty_ids").otherwise("ok"))


def sample_exact(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """Exactly n rows; the query fails if there are fewer."""
    have = df.count()
    if have < n:
        raise ValueError(f"not enough rows: wanted {n}, have {have}")
    return df.orderBy(hash_order(key, seed), key).limit(n)


def stratified_test(df: DataFrame, key: str, stratum: Column, quotas: dict[str, int], size: int, seed: str = "42") -> DataFrame:
    """Quotas per stratum, filled up from the rest to ``size``."""
    h = hash_order(key, seed)
    ranked = df.withColumn("_s", stratum).withColumn("_h", h)
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("_h", key)))
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col("_s") == name, n).otherwise(quota)
    ranked = ranked.withColumn("_tier", F.when(F.col("_r") <= quota, 0).otherwise(1))
    return ranked.orderBy("_tier", "_h", key).limit(size).drop("_h", "_r", "_tier").withColumnRenamed("_s", "stratum")


def ratio_split(df: DataFrame, key: str, ratios=((("train"), 0.9), ("dev", 0.05), ("test", 0.05)), seed: str = "42") -> DataFrame:
    """P5: cut points on a 32-bit hash of the key, so no row waits for another."""
    u = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long") / float(1 << 32)
    part, edge = F.lit(ratios[-1][0]), 1.0
    for name, share in reversed(ratios[:-1]):
        edge = sum(s for n, s in ratios[: [r[0] for r in ratios].index(name) + 1])
        part = F.when(u < edge, name).otherwise(part)
    return df.withColumn("part", part)


def assemble(candidates: DataFrame, clean: DataFrame, test: DataFrame, hard: DataFrame, key: str = "query", seed: str = "42") -> DataFrame:
    """Key and part (train, dev, test, missing)."""
    pool = clean.join(candidates.select(key), key, "left_semi").select(key).distinct().join(test.select(key), key, "left_anti")
    pool = pool.unionByName(hard.select(key).distinct().join(test.select(key), key, "left_anti")).distinct()
    n = pool.count()
    dev = min(200, max(100, int(n * 0.05)), n)
    chosen = pool.orderBy(hash_order(key, seed), key).limit(dev).withColumn("part", F.lit("dev"))
    train = pool.join(chosen.select(key), key, "left_anti").withColumn("part", F.lit("train"))
    known = train.select(key).unionByName(test.select(key))
    missing = candidates.select(key).distinct().join(known, key, "left_anti").withColumn("part", F.lit("missing"))
    return train.unionByName(chosen).unionByName(test.select(key).distinct().withColumn("part", F.lit("test"))).unionByName(missing)


def negatives(pairs: DataFrame, pool: DataFrame, n: int = 7, buckets: int = 64, seed: str = "42", ranked: int | None = None) -> DataFrame:
    """N negatives for each pair (qid, id) that differ from its positive.
    Each pair draws one bucket of the pool (id), of ``buckets`` by hash, and
    takes the n that come first in the order of a hash with its own qid.

    Every qid is hashed with its whole bucket, in blocks. Only hashes below a
    bound that about ``ranked`` (``4 * n + 20``) of a block meet are ranked; a qid
    with too few of them is hashed again with a higher one."""
    from ..plans.session import shared
    from . import drawn

    text = lambda c: F.col(c).cast("string")
    slot = F.conv(F.substring(F.md5(text("neg").cast("binary")), 1, 8), 16, 10).cast("long") % buckets
    draw = F.conv(F.substring(hash_order("qid", seed), 1, 8), 16, 10).cast("long") % buckets
    some = shared(pool.select(F.col("id").alias("neg")).where("neg is not null").distinct().withColumn("_b", slot).withColumn("_n", text("neg")))
    asked = pairs.select("qid", "id").where("qid is not null and id is not null").withColumn("_b", draw).withColumn("_q", F.concat(F.lit(seed + ":"), text("qid"), F.lit(":")))
    first = drawn.first_of_blocks(asked, some, n + 1, ranked or 4 * n + 20, buckets)  # one of them may be the positive
    order = Window.partitionBy("qid").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "qid", "neg").cast("binary")), "neg")
    return first.where("neg <> id").withColumn("rk", F.row_number().over(order).cast("long")).where(F.col("rk") <= n).select("qid", "id", "neg", "rk")


def sft_messages(turns: DataFrame, key: str, order: str, role: str, content: str) -> DataFrame:
    """One JSON text of messages for each conversation."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"))))
    messages = F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return turns.groupBy(key).agg(F.to_json(messages).alias("messages"))


def template_product(items: DataFrame, templates: list[str]) -> DataFrame:
    """Every item in every template, distinct. ``items``: item."""
    made = items.select("item", F.explode(F.array(*map(F.lit, templates))).alias("template"))
    return made.select(F.replace("template", F.lit("{}"), F.col("item")).alias("query")).distinct()


def index_records(entries: DataFrame, mode: str = "both") -> DataFrame:
    """Filled entries as index records. ``entries``: id, headword,
    alternative, definition."""
    head = T.first_filled("headword", "alternative")
    base = entries.select(F.col("id").cast("long").alias("id"), head.alias("headword"), T.clean_cell("definition").alias("definition")).where("headword <> '' and definition <> '' and id >= 0")
    return base.withColumn("index_text", T.index_text("headword", "definition", mode))


def coerce_ids(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Numeric ids where enough rows have them (100 or a tenth), else row
    numbers taken before any filter; negative ids go."""
    parsed = F.expr(f"try_cast(`{column}` as double)")
    n, good = df.agg(F.count("*"), F.count(parsed)).first()
    if good >= max(100, 0.1 * n):
        return df.withColumn("id", parsed.cast("long")).where("id >= 0")
    return numbered(df, order, name="id")


def patch_index(index: DataFrame, new: DataFrame) -> DataFrame:
    """New headwords behind the index with ids from max + 1 on."""
    fresh = first_per_key(new.join(index.select("headword"), "headword", "left_anti"), ["headword"], ["ord"])
    start = (index.agg(F.max("id")).first()[0] or -1) + 1
    added = numbered(fresh, ["ord", "headword"], start, "id").select("id", "headword", "definition")
    return index.select("id", "headword", "definition").unionByName(added)


def fill_empty(base: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """A value only where the cell is empty."""
    both = base.join(new.select(key, F.col(column).alias("_new")), key, "left")
    filled = F.coalesce(T.blank_to_null(T.strip(column)), F.col("_new"), F.lit(""))
    return both.withColumn(column, filled).drop("_new")


def resume(work: DataFrame, done: DataFrame, key: str, lists: str) -> DataFrame:
    """What no finished batch lists yet."""
    return work.join(done.select(F.explode(lists).alias(key)).distinct(), key, "left_anti")


def match_both_ways(sources: DataFrame, keys: DataFrame) -> DataFrame:
    """Sid, tier, kid of the first key of each source: an equal text
    (tier 0) before one that contains it or is contained (tier 1), then by kid.
    ``sources``: sid, text; ``keys``: kid, text. Blank texts match nothing."""
    src, key = sources.where("text <> ''"), keys.where("text <> ''")
    wide = contains_join_grams(src.withColumnRenamed("sid", "doc_id"), key.withColumnRenamed("kid", "item_id")).select(F.col("doc_id").alias("sid"), F.col("item_id").alias("kid"))
    narrow = contains_join_grams(key.withColumnRenamed("kid", "doc_id"), src.withColumnRenamed("sid", "item_id")).select(F.col("item_id").alias("sid"), F.col("doc_id").alias("kid"))
    same = src.join(key, "text").select("sid", "kid", F.lit(0).alias("tier"))
    every = same.unionByName(wide.union(narrow).withColumn("tier", F.lit(1)))
    return every.groupBy("sid").agg(F.min(F.struct("tier", "kid")).alias("m")).select("sid", "m.tier", "m.kid")


def random_templates(items: DataFrame, templates: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` of the distinct template queries, drawn by a seeded hash."""
    return template_product(items, templates).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "query")), "query").limit(n)


def notes(rows: DataFrame, cells: str, order: str) -> DataFrame:
    """S3: key, note. Rows of at least 7 cells with a seventh that is not blank
    give it under their first and their fifth cell; the last row of a key wins."""
    full = rows.where((F.size(cells) >= 7) & (F.trim(F.get(cells, F.lit(6))) != ""))
    keyed = full.select(F.explode(F.array(F.get(cells, F.lit(0)), F.get(cells, F.lit(4)))).alias("key"), F.get(cells, F.lit(6)).alias("note"), F.col(order).alias("o"))
    return keyed.groupBy("key").agg(F.max_by("note", "o").alias("note"))


def lexicon_context(hits: DataFrame, per_keyword: int = 2, most: int = 12) -> DataFrame:
    """qid, context ``keyword=headword; ...`` of the first hits of each
    keyword. ``hits``: qid, keyword, headword, place. The limits are the format's."""
    pairs = hits.groupBy("qid", "keyword", "headword").agg(F.min("place").alias("place"))
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("qid", "keyword").orderBy("place", "headword"))).where(F.col("r") <= per_keyword)
    listed = first.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("keyword", "r"))).where(F.col("n") <= most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("keyword", F.lit("="), "headword").alias("t")))), lambda x: x["t"]), "; ")
    return listed.groupBy("qid").agg(text.alias("context"))
