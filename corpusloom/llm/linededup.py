"""Removal of line runs that occur earlier in the corpus. Native throughout.

The lines of a document that have a word form a sequence of line ids (hashes
of whole lines); all sequences make up the text of a suffix array. Its order
comes from distributed prefix doubling: a rank table says, for every line that
starts a prefix of ``2**k`` lines found twice or more, where that prefix stands
in the order of all such prefixes. A round joins the table with itself at an
offset of ``2**k`` lines; the distinct pairs of ranks, sorted by range over the
cluster, are numbered in that order and become the ranks of twice the length.
Prefixes found once drop out, so later rounds see repeated text only.

Suffixes that share L lines form an interval of the suffix array at that
common prefix: two are in one interval exactly when the ranks of the first and
of the last ``2**floor(log2 L)`` of the L lines agree. From every line on the
shortest prefix of ``min_words`` words is tried, and longer ones up to that
where the next line alone has as many (what lies beyond, the next line's
prefixes cover). So the intervals reveal the maximal repeated runs, to their
last line. In every interval the earliest start (doc_id, then line) stays; each
line that a later one covers goes.

Edge cases: null and empty texts have no lines and stay as they are (null
becomes empty); lines without a word are never part of a run and stay; runs
of fewer than ``min_words`` words stay, however often they occur; a null
doc_id comes last; rows with equal doc_ids and different texts are documents of
their own, in the order of a hash of the text; rows equal in both count as one
document that is seen once; an empty table gives an empty result; further
columns pass through, whatever their names. Line hashes have 64 bits and are
not verified: among 10**9 different lines the chance of one shared hash is 3 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A repeated run of so many words or more is a copied passage.
MIN_WORDS = 50
PLACE = ["doc", "key", "i"]


def _keyed(docs: DataFrame) -> list:
    """What tells documents apart, in their order."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("key")]


def lines(docs: DataFrame) -> DataFrame:
    """doc, key, i (number among the lines with a word), at (line number in the
    text), id and words of every line that has a word."""
    flat = lambda x: F.translate(x, "\t\x0b\x0c\r", "    ")
    every = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n"),
        lambda x, at: F.struct(at.alias("at"), F.xxhash64(x).alias("id"), F.size(F.array_remove(F.split(flat(x), " "), "")).alias("words")),
    )
    found = docs.select(*_keyed(docs), F.filter(every, lambda x: x["words"] > 0).alias("s"))
    return found.select("doc", "key", F.posexplode("s").alias("i", "x")).select("doc", "key", "i", "x.at", "x.id", "x.words")


def _numbered(table: DataFrame, by: list[str]) -> DataFrame:
    """The values of ``by`` that several rows have, with their place in the
    order of all of them (``place``, not dense)."""
    again = table.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    ordered = again.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ordered.withColumn("place", F.monotonically_increasing_id()), "line-classes")


def rank_tables(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """The lines that a repeated run can have (doc, key, i, at, words), and the
    rank tables (doc, key, i, rank) of 1, 2, 4, ... lines."""
    every = stored(lines(docs), "lines")
    first = every.join(_numbered(every, ["id"]), "id").select(*PLACE, "at", "words", F.col("place").alias("rank")).distinct()
    # stretches of repeated lines without a gap; those of too few words drop out
    spread = first.withColumn("stretch", F.expr("i - row_number() over (partition by doc, key order by i)"))
    long = F.expr(f"sum(words) over (partition by doc, key, stretch) >= {min_words}")
    base = stored(spread.withColumn("long", long).where("long").select(*PLACE, "at", "words", "rank"), "repeated-lines")
    tables = [base.select(*PLACE, "rank")]
    half = 1
    while 2 * half <= min_words + 1:
        later = tables[-1].select("doc", "key", (F.col("i") - half).alias("i"), F.col("rank").alias("later"))
        pairs = stored(tables[-1].join(later, PLACE), "line-pairs")
        classes = _numbered(pairs, ["rank", "later"])
        tables.append(stored(pairs.join(classes, ["rank", "later"]).select(*PLACE, F.col("place").alias("rank")), "line-ranks"))
        half *= 2
        if tables[-1].isEmpty():
            break
    return base.drop("rank"), tables


def _need(lines, start, most: int, min_words: int):
    """How many lines from ``start`` on (``most`` at most) reach ``min_words``
    words; null if none do."""
    found = F.aggregate(
        F.slice(lines, start + 1, most),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("lines")),
        lambda s, x: F.when(s["sum"] >= min_words, s).otherwise(F.struct((s["sum"] + x["words"]).alias("sum"), (s["lines"] + 1).alias("lines"))),
    )
    return F.when(found["sum"] >= min_words, found["lines"])


def intervals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Prefixes that lie in an interval of the suffix array: doc, key, i, at and
    last (line numbers in the text), lines, and the ranks (head, tail) that all
    of one interval share."""
    base, tables = rank_tables(docs, min_words)
    every = base.select(*PLACE, "at", "words", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("rank"))
    for level, table in enumerate(tables):
        none = F.lit(None).cast("int")
        every = every.unionByName(table.select(*PLACE, none.alias("at"), none.alias("words"), F.lit(level).alias("level"), "rank"))
    ranks = [F.max(F.when(F.col("level") == k, F.col("rank"))).alias(f"r{k}") for k in range(len(tables))]
    rows = every.groupBy(*PLACE).agg(F.max("at").alias("at"), F.max("words").alias("words"), *ranks)
    names = ["i", "at", "words", *[f"r{k}" for k in range(len(tables))]]
    df = rows.groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("s"))
    few = 16
    need = lambda x: F.coalesce(_need(F.col("s"), x, few, min_words), _need(F.col("s"), x, min_words, min_words))
    top = F.lit((2 << (len(tables) - 1)) - 1)

    def of(x, n):
        """The prefix of n lines from the x-th on."""
        head = tail = F.lit(None).cast("long")
        for k in range(len(tables)):
            here = n.between(1 << k, (2 << k) - 1)
            head = F.when(here, F.get("s", x)[f"r{k}"]).otherwise(head)
            tail = F.when(here, F.get("s", x + n - (1 << k))[f"r{k}"]).otherwise(tail)
        return F.struct(F.get("s", x)["i"].alias("i"), F.get("s", x)["at"].alias("at"), F.get("s", x + n - 1)["at"].alias("last"), n.alias("lines"), head.alias("head"), tail.alias("tail"))

    spans = F.transform("s", lambda e, x: F.struct(x.alias("x"), need(x).alias("low"), F.least(1 + need(x + 1), F.size("s") - x, top).alias("high")))
    df = df.select("doc", "key", "s", F.filter(spans, lambda t: t["low"] <= top).alias("spans"))
    prefixes = F.flatten(F.transform("spans", lambda t: F.transform(F.sequence(t["low"], F.greatest(t["low"], F.coalesce(t["high"], t["low"]))), lambda n: of(t["x"], n))))
    return df.select("doc", "key", F.inline(F.filter(prefixes, lambda p: p["head"].isNotNull() & p["tail"].isNotNull())))


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Line ranges (doc, key, at, last) that repeat an earlier run."""
    every = stored(intervals(docs, min_words), "line-intervals")
    by = ["lines", "head", "tail"]
    first = every.groupBy(*by).agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")).where("n > 1").select(*by, "first")
    return every.join(stored(first, "line-firsts"), by).where("struct(doc, key, i) <> first").select("doc", "key", "at", "last")


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs taken out of ``text``,
    and the columns ``n_lines``, ``n_removed`` and ``n_runs`` (columns of these
    names are replaced)."""
    cuts = repeated(docs, min_words).groupBy("doc", "key").agg(F.sort_array(F.collect_set(F.struct("at", "last"))).alias("cuts"))
    merged = F.aggregate(
        "cuts",
        F.array().cast("array<struct<at:int,last:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["at"] <= F.element_at(acc, -1)["last"] + 1), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["at"].alias("at"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last"))))).otherwise(
            F.concat(acc, F.array(F.struct(x["at"].alias("at"), x["last"].alias("last"))))
        ),
    )
    cuts = cuts.select("doc", "key", merged.alias("cuts"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.coalesce("text", F.lit("")).alias("text"), *_keyed(docs)).join(cuts, ["doc", "key"], "left")
    lines = F.split("text", "\n")
    word = "[^ \\t\\x0B\\f\\r]"
    kept = F.filter(lines, lambda x, i: ~F.exists("cuts", lambda s: (s["at"] <= i) & (i <= s["last"])) | ~x.rlike(word))
    removed = F.col("cuts").isNotNull()
    done = both.select(
        "row",
        F.when(removed, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("new_text"),
        F.size(lines).cast("long").alias("all_lines"),
        F.when(removed, F.size(lines) - F.size(kept)).otherwise(0).cast("long").alias("gone"),
        F.when(removed, F.size("cuts")).otherwise(0).cast("long").alias("runs"),
    )
    columns = [F.col("new_text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in own]
    return done.select(*columns, F.col("all_lines").alias("n_lines"), F.col("gone").alias("n_removed"), F.col("runs").alias("n_runs"))
