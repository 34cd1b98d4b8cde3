"""Tokenisers, n-grams, query variants and other array-valued columns.

Every function keeps first-seen order, as ``array_distinct`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .text import CJK, _col, markup_off, normalize_search, squeeze, strip

NONE = "array<string>"


def nothing() -> Column:
    return F.array().cast(NONE)


def ngrams(text, n: int) -> Column:
    """All substrings of n characters in order; none if the text is shorter."""
    x = _col(text)
    return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substr(x, i, F.lit(n)))).otherwise(nothing())


def sparse_tokens(text) -> Column:
    """separators are deleted first; runs of ``[a-z0-9_]`` are one token,
    other runs give their characters, then their bigrams; distinct."""
    clean = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), "(?U)[^\\w\\u4e00-\\u9fff]+", "")
    runs = F.regexp_extract_all(clean, F.lit("[a-z0-9_]+|[^a-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[a-z0-9_]"), F.array(r)).otherwise(F.concat(ngrams(r, 1), ngrams(r, 2))))))


def word_tokens(text) -> Column:
    """Distinct lower-case runs of letters and digits, for spaced languages."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))


def significant(tokens) -> Column:
    """without low-information tokens."""
    return F.array_except(_col(tokens), F.array(*map(F.lit, W.LOW_INFORMATION)))


def meaningful(text, single: bool | Column = False) -> Column:
    """something is left that can be searched for."""
    x = squeeze(text)
    alone = single if isinstance(single, Column) else F.lit(single)
    return (x != "") & (alone | (F.length(x) != 1)) & (F.size(significant(sparse_tokens(x))) > 0)


def cjk_bigrams(text) -> Column:
    """bigrams of the CJK characters, repeats kept; one character alone is
    a token."""
    x = F.regexp_replace(_col(text), "[^\\u4e00-\\u9fff]", "")
    return F.when(F.length(x) == 1, F.array(x)).otherwise(ngrams(x, 2))


def gram_set(text, most: int = 3) -> Column:
    """distinct n-grams of 1 to ``most`` characters."""
    return F.array_distinct(F.concat(*[ngrams(text, n) for n in range(1, most + 1)]))


def substrings(text, low: int = 2, high: int = 6) -> Column:
    """distinct substrings, longer ones first."""
    x = squeeze(text)
    return F.array_distinct(F.concat(*[ngrams(x, n) for n in range(high, low - 1, -1)]))


def keyword_windows(text) -> Column:
    """the whole, the first three, last two, last three, first two
    characters, then all n-grams of four to two, without stop words."""
    x = F.regexp_replace(_col(text), "[^\\u4e00-\\u9fffA-Za-z0-9]", "")
    n = F.length(x)
    ends = F.array(F.substr(x, F.lit(1), F.lit(3)), F.substr(x, n - 1, F.lit(2)), F.substr(x, n - 2, F.lit(3)), F.substr(x, F.lit(1), F.lit(2)))
    stop = F.array(*map(F.lit, W.WINDOW_STOPWORDS))
    rest = F.filter(F.concat(ends, *[ngrams(x, k) for k in (4, 3, 2)]), lambda t: ~F.array_contains(stop, t))
    return F.when(n == 0, nothing()).when(n <= 2, F.array(x)).otherwise(F.array_distinct(F.concat(F.array(x), rest)))


def chunk_terms(text, chunks, most: int = 12) -> Column:
    """F8: the text, its chunks, their bigrams and trigrams; the first few."""
    grams = lambda n: F.flatten(F.transform(_col(chunks), lambda c: ngrams(c, n)))
    return F.slice(F.array_distinct(F.concat(F.array(_col(text)), _col(chunks), grams(2), grams(3))), 1, most)


def split_keywords(text, most: int = 4) -> Column:
    """parts of two characters or more between punctuation, else the whole."""
    parts = F.slice(F.filter(F.transform(F.split(_col(text), "[，。；、！？,;!?\\s：:]+"), strip), lambda p: F.length(p) >= 2), 1, most)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(text)))


def definition_keywords(definition, headword) -> Column:
    """up to three CJK parts of a definition that differ from the headword."""
    text = F.replace(markup_off(definition), F.lit("～"), _col(headword))
    parts = F.filter(F.split(text, "[，。；、：:;,丨\\s]+"), lambda p: p.rlike(f"^{CJK}{{1,8}}$") & (p != _col(headword)))
    return F.slice(F.array_distinct(parts), 1, 3)


def examples(definition, headword) -> Column:
    """up to three pieces after a colon that contain the headword."""
    after = F.regexp_extract(_col(definition), "(?s)[：:](.*)$", 1)
    return F.slice(F.filter(F.transform(F.split(after, "[。！？丨|]"), strip), lambda p: (F.length(p) >= 3) & F.contains(p, F.replace(_col(headword), F.lit("～"), F.lit("")))), 1, 3)


def concepts(text) -> Column:
    """what a question is about, by four patterns."""
    x = _col(text)
    found = [
        F.regexp_extract(x, f"怎么(?:说|讲|表达)({CJK}+)", 1),
        F.regexp_extract(x, f"({CJK}+)(?:是什么意思|啥意思)", 1),
        F.regexp_extract(x, f"({CJK}{{2,}})怎么说", 1),
        F.regexp_extract(x, f"({CJK}{{2,}})这个", 1),
    ]
    return F.array_distinct(F.filter(F.array(*found), lambda c: c != ""))


def praise(text) -> Column:
    """the attribute that is praised, if any."""
    x = F.regexp_extract(_col(text), f"(?:夸人|夸|称赞|赞)({CJK}{{1,3}})$", 1)
    return F.when(~x.isin("", "人", "别人", "对方"), x)


def negations(text) -> Column:
    """F16: for every 不 between two CJK characters (matches don't overlap) the
    text with 勿 in its place."""
    x = _col(text)
    n = F.length(x)
    ok = lambda i: (F.substr(x, i, F.lit(1)) == "不") & F.substr(x, i - 1, F.lit(1)).rlike(CJK) & F.substr(x, i + 1, F.lit(1)).rlike(CJK)
    places = F.when(n >= 3, F.filter(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), ok)).otherwise(F.array().cast("array<int>"))
    apart = F.aggregate(places, F.array().cast("array<int>"), lambda acc, i: F.when((F.size(acc) > 0) & (i - F.element_at(acc, -1) < 3), acc).otherwise(F.concat(acc, F.array(i))))
    return F.transform(apart, lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.lit("勿"), F.substr(x, i + 1, n)))


def dialect_variants(text) -> Column:
    """the text, then one variant for each word pair that occurs."""
    x = _col(text)
    made = F.transform(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in W.DIALECT_PAIRS]), lambda p: F.when(F.contains(x, p["a"]), F.replace(x, p["a"], p["b"])))
    return F.array_distinct(F.concat(F.array(x), F.array_compact(made)))


def with_query_variants(df: DataFrame, text: str, name: str = "variants") -> DataFrame:
    """the base form and up to five kinds of reduced forms, in order.
    Steps are columns of their own, so no step is written out twice."""
    from functools import reduce

    from .text import SPACE, without

    ends_with = lambda x, parts: reduce(lambda a, b: a | b, [x.endswith(p) for p in parts])
    base = F.col("_base")
    df = df.withColumn("_base", normalize_search(text))
    chosen = base
    for p in reversed(W.PREFIXES):
        chosen = F.when(base.startswith(p) & (F.length(base) > len(p) + 1), F.substr(base, F.lit(len(p) + 1))).otherwise(chosen)
    df = df.withColumn("_cut", chosen)
    cut = F.col("_cut")
    segments = F.regexp_extract_all(base, F.lit(f"{CJK}{{2,}}"), F.lit(0))
    df = df.select(
        "*",
        strip(F.when(ends_with(cut, W.SUFFIXES) & (F.length(cut) > 2), F.substr(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)).alias("_trimmed"),
        strip(F.regexp_replace(without(base, W.REMOVABLE), SPACE, " ")).alias("_generic"),
        F.when(ends_with(base, W.PRONOUNS) & (F.length(base) > 1), strip(without(F.regexp_replace(strip(F.substr(base, F.lit(1), F.length(base) - 1)), SPACE, " "), W.REMOVABLE))).alias("_core"),
        segments.alias("_segments"),
        concepts("_base").alias("_concepts"),
    )
    longest = F.when(F.size("_segments") >= 3, F.element_at(F.filter("_segments", lambda x: F.length(x) == F.array_max(F.transform("_segments", lambda t: F.length(t)))), 1))
    mark = lambda v, single=False: F.struct(v.alias("v"), F.lit(single).alias("single"))
    found = F.concat(F.array(mark(F.col("_trimmed")), mark(F.col("_generic")), mark(F.col("_core"), True), mark(longest)), F.transform("_concepts", lambda c: mark(c)))
    kept = F.filter(found, lambda s: s["v"].isNotNull() & (s["v"] != base) & meaningful(s["v"], s["single"]))
    every = F.array_distinct(F.filter(F.concat(F.array(base), F.transform(kept, lambda s: s["v"])), lambda v: v != ""))
    return df.withColumn(name, every).drop("_base", "_cut", "_trimmed", "_generic", "_core", "_segments", "_concepts")


def search_terms(message, core, segments, keywords) -> Column:
    """what the lookup tries, in order."""
    from .text import normalize_shared

    stripped = normalize_shared(message)
    tidy = lambda a: F.filter(F.transform(F.coalesce(_col(a), nothing()), strip), lambda x: x != "")
    first = F.array_distinct(F.concat(F.array(stripped, strip(core)), tidy(segments), tidy(keywords), F.slice(substrings(stripped), 1, 8)))
    first = F.filter(first, lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(F.concat(first, F.array_compact(F.transform(first, praise))))


def bucket100(text) -> Column:
    """the first eight hex digits of the md5, modulo 100."""
    return (F.conv(F.substring(F.md5(_col(text).cast("binary")), 1, 8), 16, 10).cast("long") % 100).cast("int")


def split_name(text) -> Column:
    """80/10/10."""
    b = bucket100(text)
    return F.when(b < 80, "train").when(b < 90, "dev").otherwise("test")


def _times(text: Column, char: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, char, F.lit("")))


def char_counts(text) -> Column:
    """The distinct characters of a text with their numbers."""
    x = _col(text)
    return F.transform(F.array_distinct(ngrams(x, 1)), lambda c: F.struct(c.alias("c"), _times(x, c).alias("n")))


def chars_in(counts, text) -> Column:
    """How many of these characters another text has too, repeats counted."""
    y = _col(text)
    return F.aggregate(counts, F.lit(0), lambda s, e: s + F.least(e["n"], _times(y, e["c"])))


def char_overlap(a, b) -> Column:
    """characters that two texts share, repeats counted."""
    return chars_in(char_counts(a), b)


def bmes(segments) -> Column:
    """one tag a character."""
    return F.flatten(F.transform(_col(segments), lambda s: F.when(F.length(s) == 1, F.array(F.lit("S"))).when(F.length(s) < 1, nothing()).otherwise(F.concat(F.array(F.lit("B")), F.array_repeat(F.lit("M"), F.length(s) - 2), F.array(F.lit("E"))))))


def word_ends(tags) -> Column:
    """(begin, end) of each word; S and E close one, and so does the end."""
    t = _col(tags)
    state = F.struct(F.lit(0).alias("begin"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"), F.lit(0).alias("i"))
    step = lambda s, x: F.struct(
        F.when(x.isin("S", "E"), s["i"] + 1).otherwise(s["begin"]).alias("begin"),
        F.when(x.isin("S", "E"), F.concat(s["out"], F.array(F.struct(s["begin"].alias("begin"), (s["i"] + 1).alias("end"))))).otherwise(s["out"]).alias("out"),
        (s["i"] + 1).alias("i"),
    )
    done = lambda s: F.when(s["begin"] < s["i"], F.concat(s["out"], F.array(F.struct(s["begin"].alias("begin"), s["i"].alias("end"))))).otherwise(s["out"])
    return F.aggregate(t, state, step, done)


def bmes_valid(tags, strict: bool = False) -> Column:
    """The lenient form lets a word stay open at the end; the strict one
    wants whole words."""
    joined = F.array_join(_col(tags), "")
    return joined.rlike("^(?:S|BM*E)*$") if strict else joined.rlike("^(?:S|BM*E|BM*(?=S|$))*$")


def slash_format(tokens, tags) -> Column:
    """``word/TAG#word/TAG``."""
    return F.array_join(F.zip_with(_col(tokens), _col(tags), lambda a, b: F.concat(a, F.lit("/"), b)), "#")


def headword_parts(c) -> Column:
    """(joined, parts) of a headword split on ``|``; blank parts go."""
    parts = F.filter(F.split(c, r"\|"), lambda x: F.trim(x) != "")
    return F.struct(F.array_join(parts, "").alias("joined"), parts.alias("parts"))


def char_tags(segments: Column, tag: Column) -> Column:
    """a tag for each character; ``vn`` is V on the first segment and N on
    the others."""
    of = lambda i: F.when(tag == "vn", F.when(i == 0, "V").otherwise("N")).otherwise(tag)
    return F.flatten(F.transform(segments, lambda s, i: F.array_repeat(of(i), F.length(s))))


def candidate_lines(items: Column) -> Column:
    """one line a candidate of (id, headword, definition)."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("ID:"), x["id"].cast("string"), F.lit(" | "), x["headword"], F.lit(" | "), x["definition"])), "\n")


def replace_terms(text: Column, pairs: Column) -> Column:
    """every (key, value) of an array replaced in turn, longest key first,
    keys of one length in their own order."""
    order = F.array_sort(F.transform(pairs, lambda p: F.struct((-F.length(p["key"])).alias("n"), p["key"].alias("key"), p["value"].alias("value"))))
    return F.aggregate(order, text, lambda t, p: F.replace(t, p["key"], p["value"]))


def final_render(kind, keywords) -> Column:
    """F35"""
    return F.concat(F.when(_col(kind) == "词项", "【单词】").otherwise("【短语】"), F.lit("\n"), F.array_join(_col(keywords), ","))
