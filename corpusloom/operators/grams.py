"""Substring search by an equi join: a text that contains a keyword contains
every gram of it.

Each keyword is looked up by its rarest gram of ``size`` characters (a shorter
keyword is its own gram), and only texts with that gram are compared with the
keyword. Grams of the texts are formed for the lengths that keywords have, and
those that no keyword has go before the shuffle if the keywords' grams are few
enough for Spark to send them, after it otherwise. A gram that very many texts
share is one join key; Spark's skew join splits it, and first-k results are cut
down in every task before they meet.

Edge cases: null and empty keywords and null texts match nothing; repeated rows
match each; keywords are literal, upper and lower case differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _col
from ..plans.session import shared, sized

SIZE = 5


def grams_of(text, size: int):
    """Distinct grams of one length."""
    text = _col(text)
    count = F.length(text) - (size - 1)
    every = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(count > 0, F.array_distinct(every))


def containing(texts: DataFrame, keywords: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, keyword) for every text that contains the keyword, once each.
    ``texts``: id, text; ``keywords``: keyword."""
    asked = shared(keywords.where("keyword is not null and keyword <> ''").select("keyword").distinct())
    length = F.least(F.length("keyword"), F.lit(size))
    lengths = sorted(r[0] for r in asked.select(length).distinct().collect())  # at most ``size`` numbers
    if not lengths:
        return texts.select("id", F.lit("").alias("keyword")).where("false")
    own = posts = None
    for n in lengths:
        mine = asked.where(length == n).select("keyword", F.explode(grams_of("keyword", n)).alias("gram"))
        every = texts.where("text is not null").select("id", F.explode(grams_of("text", n)).alias("gram"))
        own = mine if own is None else own.unionByName(mine)
        posts = every if posts is None else posts.unionByName(every)
    held = shared(posts.join(sized(own.select("gram").distinct()), "gram", "left_semi"))
    rare = own.join(held.groupBy("gram").agg(F.count("*").alias("df")), "gram", "left")
    # a gram that no text has comes first and ends the search for its keyword
    key = rare.groupBy("keyword").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
    pairs = key.join(held, "gram").select("id", "keyword")
    return pairs.join(texts, "id").where(F.contains("text", F.col("keyword"))).select("id", "keyword").distinct()


def keyword_filter(queries: DataFrame, texts: DataFrame, k: int = 20, size: int = SIZE) -> DataFrame:
    """Qid, id, rk of the first ``k`` texts, in the order of ``ord``, that
    contain any of a query's keywords; a query without a keyword takes the
    first ``k`` of the table, one whose keywords match nothing has no row.
    ``queries``: qid, keywords; ``texts``: id, ord, text."""
    each = queries.select("qid", F.explode(F.filter("keywords", lambda w: w.isNotNull() & (w != ""))).alias("keyword"))
    place = texts.select("id", "ord")
    # the first k texts of a keyword are enough for the first k of a query
    best = Window.partitionBy("keyword").orderBy("ord", "id")
    found = containing(texts.select("id", "text"), each, size).join(place, "id").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    hits = each.join(found, "keyword").select("qid", "id", "ord").distinct()
    none = queries.where(F.size(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: w.isNotNull() & (w != ""))) == 0).select("qid")
    head = place.orderBy("ord", "id").limit(k)
    rows = hits.unionByName(none.join(F.broadcast(head)).select("qid", "id", "ord"))  # k rows
    order = Window.partitionBy("qid").orderBy("ord", "id")
    return rows.withColumn("rk", F.row_number().over(order).cast("long")).where(F.col("rk") <= k).select("qid", "id", "rk")


def keyword_split(text, most: int = 4):
    """parts of two characters or more between CJK and ASCII punctuation,
    ``most`` of them; the whole text if there are none."""
    parts = F.filter(F.transform(F.split(F.trim(_col(text)), "[，。、“”‘’；：？！,\\s/()（）]+"), lambda p: F.trim(p)), lambda p: F.length(p) >= 2)
    return F.when(F.size(parts) > 0, F.slice(parts, 1, most)).otherwise(F.array(F.trim(_col(text))))
