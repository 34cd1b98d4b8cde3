"""Segmentation and tagging with a lexicon table (word, tags)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.session import sized
from .labels import TAGS

# fixed values: characters that are always punctuation tokens
PUNCTUATION = "，。？！；：“”‘’（）【】《》、…—～·,.?!;:'\"()[]{}<>"
# fixed values: place words that join a noun
PLACE_WORDS = "头里 头上 头下 里向 外向".split()
# fixed values: part-of-speech names, tried in this order
POS_NAMES = {
    "n": "N", "名": "N", "名词": "N", "v": "V", "动": "V", "动词": "V", "a": "A", "形": "A", "形容词": "A", "m": "M", "数": "M", "数词": "M", "q": "Q", "量": "Q", "量词": "Q", "r": "R", "代": "R", "代词": "R",
    "d": "D", "副": "D", "副词": "D", "p": "P", "介": "P", "介词": "P", "c": "C", "连": "C", "连词": "C", "sp": "SP", "结构助词": "SP", "助": "SP", "as": "AS", "体貌助词": "AS", "体": "AS", "y": "Y", "语气助词": "Y", "语气": "Y",
    "fw": "FW", "框式虚词": "FW", "i": "I", "叹": "I", "叹词": "I", "o": "O", "拟": "O", "拟声词": "O", "idm": "IDM", "习语": "IDM", "成语": "IDM", "vn": "vn", "nd": "nd",
}


def normalize_pos(raw) -> Column:
    """the exact name, else the first name inside the text, else N."""
    p = F.lower(T.strip(raw))
    out = F.lit("N")
    for name, tag in reversed(POS_NAMES.items()):
        out = F.when(F.contains(p, F.lit(name)), tag).otherwise(out)
    for name, tag in POS_NAMES.items():
        out = F.when(p == name, tag).otherwise(out)
    return out


def pos_from_definition(definition) -> Column:
    """F29"""
    found = F.regexp_extract(T._col(definition), "^[〈<](.{1,4})[〉>]", 1)
    return F.when(found != "", normalize_pos(found))


def load_lexicon(rows: DataFrame) -> DataFrame:
    """Word and its tags in first-seen order. ``rows``: ord, word, tags."""
    parts = F.filter(F.transform(F.split("tags", "[+/]"), T.strip), lambda t: t != "")
    valid = F.filter(parts, lambda t: t.isin(*TAGS))
    base = rows.select("ord", T.strip(F.replace("word", F.lit("|"), F.lit(""))).alias("word"), F.when(F.size(valid) > 0, valid).otherwise(F.array(T.strip("tags"))).alias("tags")).where("word <> '' and word <> 'nan'")
    # tags that a word has in many rows count once, at their first place
    base = base.groupBy("word", "tags").agg(F.min("ord").alias("ord"))
    grouped = base.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("ord", "tags"))).alias("x"))
    return grouped.select("word", F.array_distinct(F.flatten(F.transform("x", lambda s: s["tags"]))).alias("tags"))


def segment(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """G1: forward maximum matching: id, pos (token number), token, tags.

    For every place the longest lexicon word that starts there is found by an
    equi join on substrings; the chain of places is then followed inside each
    sentence's own row. The lexicon is stored, so that Spark knows its size and
    sends it to the substrings while it is small: these have few frequent words,
    which would be a task each.
    """
    lexicon = sized(lexicon)
    longest = lexicon.agg(F.coalesce(F.max(F.length("word")), F.lit(1))).first()[0]
    x = F.col("sentence")
    places = sentences.where(F.length("sentence") > 0).select("id", "sentence", F.explode(F.sequence(F.lit(1), F.length(x))).alias("at"))
    ch = F.substr(x, F.col("at"), F.lit(1))
    forms = places.select("id", "at", ch.alias("ch"), F.length(x).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(x) - F.col("at") + 1)), lambda k: F.substr(x, F.col("at"), k))).alias("word"))
    forms = forms.where(~F.col("ch").isin(*PUNCTUATION))
    best = forms.join(lexicon, "word").groupBy("id", "at").agg(F.max_by(F.struct("word", "tags"), F.length("word")).alias("best"))
    steps = places.select("id", "at", ch.alias("ch")).join(best, ["id", "at"], "left")
    token = F.coalesce(F.col("best.word"), F.col("ch"))
    tags = F.when(F.col("ch").isin(*PUNCTUATION), F.array(F.lit("PU"))).otherwise(F.coalesce(F.col("best.tags"), F.array(F.lit("X"))))
    line = steps.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", token.alias("token"), tags.alias("tags")))).alias("line"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<token:string,tags:array<string>>>").alias("out"))
    walk = F.aggregate(
        "line",
        start,
        lambda s, p: F.when(p["at"] == s["next"], F.struct((s["next"] + F.length(p["token"])).alias("next"), F.concat(s["out"], F.array(F.struct(p["token"].alias("token"), p["tags"].alias("tags")))).alias("out"))).otherwise(s),
        lambda s: s["out"],
    )
    return line.select("id", F.posexplode(walk).alias("pos", "t")).select("id", F.col("pos").cast("long").alias("pos"), "t.token", "t.tags")


# fixed values: tags of words that a place word joins
NOMINAL = ("N", "R", "VN")
# fixed values: of a word's tags the choice, by the first line whose tags it
# has; (tags, choice if the neighbour fits, neighbour, its tags, else)
CHOICES = [
    (("FW",), "FW", None, (), None),
    (("ND",), "ND", None, (), None),
    (("IDM",), "IDM", None, (), None),
    (("V", "N"), "V", "before", ("R", "N", "VN", ""), "N"),
    (("V", "A"), "V", None, (), None),
    (("A", "N"), "N", "after", ("Q", "M"), "A"),
]


def _last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def _joined(line) -> Column:
    """G2 as a fold: a place word goes to the nominal word before it, a
    structural particle to whatever stands before it."""
    word = lambda token, tags, free: F.struct(token.alias("token"), tags.alias("tags"), free.alias("free"))
    but_last = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))

    def step(done, x):
        last, first = _last(done), F.get(x["tags"], F.lit(0))
        longer = F.concat(last["token"], x["token"])
        place = last["free"] & x["token"].isin(*PLACE_WORDS)
        grown = F.when(place, word(longer, F.array(F.lit("ND")), F.lit(False))).when((first == "SP") & last.isNotNull(), word(longer, last["tags"], F.lit(False)))
        return F.when(grown.isNotNull(), F.concat(but_last(done), F.array(grown))).otherwise(F.concat(done, F.array(word(x["token"], x["tags"], F.coalesce(first.isin(*NOMINAL), F.lit(False))))))

    return F.aggregate(line, F.array().cast("array<struct<token:string,tags:array<string>,free:boolean>>"), step)


def _chosen(tags: Column, before: Column, after: Column) -> Column:
    """One of a word's tags by the table of choices."""
    near = {"before": before, "after": after}
    out = F.get(tags, F.lit(0))
    for needed, yes, side, fits, no in reversed(CHOICES):
        has = F.lit(True)
        for t in needed:
            has = has & F.array_contains(tags, t)
        out = F.when(has, yes if side is None else F.when(near[side].isin(*fits), yes).otherwise(no)).otherwise(out)
    return F.when(F.size(tags) == 1, F.get(tags, F.lit(0))).otherwise(out)


def tag(segmented: DataFrame) -> DataFrame:
    """Id, annotation (``word/TAG#...``). ``segmented``: id, pos,
    token, tags; a sentence is one row, folded from left to right."""
    line = segmented.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "tags"))).alias("line"))
    joined = line.select("id", _joined("line").alias("w"))
    ahead = joined.select("id", F.transform("w", lambda x, i: F.struct(x["token"].alias("token"), x["tags"].alias("tags"), F.coalesce(F.get(F.get("w", i + 1)["tags"], F.lit(0)), F.lit("")).alias("after"))).alias("w"))
    start = F.struct(F.lit("").alias("before"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        chosen = _chosen(x["tags"], s["before"], x["after"])
        return F.struct(chosen.alias("before"), F.concat(s["out"], F.array(F.concat(x["token"], F.lit("/"), chosen))).alias("out"))

    return ahead.select("id", F.array_join(F.aggregate("w", start, step, lambda s: s["out"]), "#").alias("annotation"))


# fixed values: BMES transitions that are allowed, first and last tags
FOLLOWS = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}
FIRST, LAST = "BS", "ES"


def viterbi(rows: DataFrame) -> DataFrame:
    """Best valid tag path of (id, emissions: array of 4 scores B M E S), as
    a fold whose state is the best path into each tag. Equal scores take the
    earlier tag in the order B M E S; no emissions, and one that no valid path
    ends, give no tags."""
    order = "BMES"
    kind = "struct<score:double,path:string>"
    none = F.lit(None).cast(kind)
    way = lambda score, path: F.struct(score.cast("double").alias("score"), path.alias("path"))
    better = lambda x, y: F.when(x.isNull() | (y["score"] > x["score"]), y).otherwise(x)

    def step(state, now):
        into = []
        for k, t in enumerate(order):
            best = none
            for q in order:
                if t in FOLLOWS[q]:
                    best = better(best, state[q])
            first = way(now[k], F.lit(t)) if t in FIRST else none
            into.append(F.when(state["begun"], F.when(best.isNotNull(), way(best["score"] + now[k], F.concat(best["path"], F.lit(t))))).otherwise(first).alias(t))
        return F.struct(F.lit(True).alias("begun"), *into)

    def end(state):
        best = none
        for t in LAST:
            best = better(best, state[t])
        return F.filter(F.split(F.coalesce(best["path"], F.lit("")), ""), lambda x: x != "")

    start = F.struct(F.lit(False).alias("begun"), *[none.alias(t) for t in order])
    emissions = F.transform("emissions", lambda e: F.transform(e, lambda v: v.cast("double")))
    return rows.select("id", F.aggregate(emissions, start, step, end).alias("tags"))


def core_span(text, probabilities, threshold: float = 0.5) -> Column:
    """The run of characters at or above the threshold with the largest
    sum of probabilities (mean times length)."""
    x, p = T._col(text), T._col(probabilities)
    empty = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("begin"), F.lit(0.0).alias("sum"), F.lit(-1).alias("best"), F.lit(-1).alias("end"), F.lit(0.0).alias("score"))

    def step(s, v):
        on = v >= threshold
        begin = F.when(on & (s["begin"] < 0), s["i"]).when(on, s["begin"]).otherwise(F.lit(-1))
        total = F.when(on, s["sum"] + v).otherwise(F.lit(0.0))
        closes = ~on & (s["begin"] >= 0) & (s["sum"] > s["score"])
        return F.struct((s["i"] + 1).alias("i"), begin.alias("begin"), total.alias("sum"), F.when(closes, s["begin"]).otherwise(s["best"]).alias("best"), F.when(closes, s["i"]).otherwise(s["end"]).alias("end"), F.when(closes, s["sum"]).otherwise(s["score"]).alias("score"))

    done = F.aggregate(F.concat(F.transform(p, lambda v: v.cast("double")), F.array(F.lit(-1.0))), empty, step)
    return F.when(done["best"] < 0, "").otherwise(F.regexp_replace(F.substr(x, done["best"] + 1, done["end"] - done["best"]), "^[，,。.!！？?；;：:、]+|[，,。.!！？?；;：:、]+$", ""))


def contains_tagged(sentence, segments) -> Column:
    """BMES tags of a sentence with one known word inside: the word's own
    tags at its first place, S elsewhere; null if it is absent."""
    from ..functions import tokens as K

    word = F.array_join(T._col(segments), "")
    x = T._col(sentence)
    at = F.instr(x, word)
    tail = F.length(x) - at - F.length(word) + 1
    return F.when((at > 0) & (word != ""), F.concat(F.array_repeat(F.lit("S"), at - 1), K.bmes(segments), F.array_repeat(F.lit("S"), tail)))
