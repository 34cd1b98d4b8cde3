"""URL filters: fixed host and path rules, and mined association rules.
Native throughout.

The tokens of a URL are its host's labels (``h:``), the words of labels that
have several (``w:``), the words of its path (``p:``) and its parameter names
(``q:``); a label of one word is one token, since two that always occur
together would double the itemsets. Spark's FP-growth
runs over the token sets of labelled URLs with the item ``bad`` added to bad
ones; association rules whose consequent is ``bad`` stay when confidence and
support suffice, and a rule goes when its antecedent less one token already
makes a rule that is as sure (it matches wherever the longer one does). Rules match through an inverted index: each is entered
under its rarest token, URL tokens are joined to the entries, and the rest of
the antecedent is checked on the URL's own token set.

Labels: a page is bad when a ``labels`` row of the same number has quality 0
or toxic 1, or when its host has one of ``SEED_TERMS``, a documented seed list
of unwanted trades; every page with a row or a seed term is labelled.

Edge cases: a null URL, or one without ``://``, has empty host and path, no
tokens and is allowed; equal URLs get equal verdicts (judged once); without
labels there are no mined rules; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed rules: (verdict, host and path prefix).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SEED_TERMS = ("casino", "pills", "bets", "spam", "ads", "porn", "warez")
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case; empty for null and without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (nulls if none). A rule
    fits its host and all subdomains, when the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL."""
    host, rest = host_of(url), _rest(url)
    labels = F.array_remove(F.split(host, "\\."), "")
    words = F.flatten(F.transform(labels, lambda x: F.when(x.rlike("[^a-z0-9]"), F.array_remove(F.split(x, "[^a-z0-9]+"), "")).otherwise(F.array().cast("array<string>"))))
    path = F.array_remove(F.split(F.lower(path_of(url)), "[^a-z0-9]+"), "")
    names = F.regexp_extract_all(F.lower(F.coalesce(rest, F.lit(""))), F.lit("[?&]([a-z0-9_]+)="), 1)
    mark = lambda prefix: lambda x: F.concat(F.lit(prefix), x)
    return F.array_distinct(F.concat(F.transform(labels, mark("h:")), F.transform(words, mark("w:")), F.transform(path, mark("p:")), F.transform(names, mark("q:"))))


def labelled(pages: DataFrame, labels: DataFrame, seeds=SEED_TERMS) -> DataFrame:
    """tokens and bad (boolean) of every labelled page."""
    known = labels.groupBy(F.col("doc_id").alias("_doc")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("_bad"))
    seed = F.arrays_overlap("tokens", F.array(*[F.lit(f"{kind}:{s}") for kind in "hw" for s in seeds]))
    both = pages.select(F.col("page_id").alias("_page"), tokens_of(F.col("url")).alias("tokens")).join(known, F.col("_page") == F.col("_doc"), "left")
    return both.where(F.col("_bad").isNotNull() | seed).select("tokens", (seed | F.coalesce("_bad", F.lit(False))).alias("bad"))


def mine(train: DataFrame, least_support: float = 0.001, least_count: int = 5, confidence: float = 0.8) -> DataFrame | None:
    """Association rules: antecedent (sorted), key (its rarest token),
    confidence and support; None without labelled rows of both kinds."""
    n, bad = train.agg(F.count("*"), F.count_if("bad")).first()
    if not n or not bad:
        return None
    items = train.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit("bad")))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(least_support, least_count / n), minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit("bad"))).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    single = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    keyed = rules.select("*", F.explode("antecedent").alias("token")).join(single, "token")
    keyed = keyed.groupBy("antecedent", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    keyed = stored(keyed, "url-rules")
    known = keyed.select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    less = keyed.select("antecedent", "confidence", F.explode("antecedent").alias("t")).select("antecedent", "confidence", F.array_remove("antecedent", F.col("t")).alias("part"))
    covered = less.join(known, "part").where("part_confidence >= confidence").select("antecedent").distinct()
    return stored(keyed.join(covered, "antecedent", "left_anti"), "pruned-url-rules")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, confidence and the antecedent of the surest rule that fits."""
    entries = rules.select(F.col("key").alias("token"), "antecedent", "confidence")
    tokens = urls.select("url", tokens_of(F.col("url")).alias("tokens")).select("url", "tokens", F.explode("tokens").alias("token"))
    found = tokens.join(entries, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max_by(F.struct(F.col("confidence"), F.array_join("antecedent", " ").alias("mined")), F.struct("confidence", -F.size("antecedent"), F.array_join("antecedent", " ")))
    return found.groupBy("url").agg(best.alias("best")).select(F.col("url").alias("_url"), "best.mined", "best.confidence")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, mined rule of every page."""
    base = pages.select("page_id", "url")
    mined = mine(labelled(base, labels), **options)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    if mined is None:
        both = base.withColumn("mined", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    else:
        found = matches(base.where("url is not null").select("url").distinct(), mined)
        both = base.join(found, F.col("url") == F.col("_url"), "left")
    out = both.select("page_id", host.alias("host"), path.alias("path"), "mined", "confidence")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined", "confidence")
