"""Text normalisers, filters and predicates as columns.

Four query normalisers differ on purpose and keep their own names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

CJK = "[\\u4e00-\\u9fff]"
SPACE = "(?U)\\s+"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x) -> Column:
    return F.nullif(_col(x), F.lit(""))


def strip(x) -> Column:
    """White space off both ends, Unicode spaces too."""
    return F.regexp_replace(_col(x), "(?U)^\\s+|\\s+$", "")


def without(x, parts) -> Column:
    """Literal parts deleted one after the other."""
    return reduce(lambda c, p: F.replace(c, F.lit(p), F.lit("")), parts, _col(x))


def _shells_off(text: Column, shells) -> Column:
    text = F.regexp_replace(without(text, shells), "[\"'，,。.!！?？；;：:（）()\\[\\]【】]+", " ")
    return strip(F.regexp_replace(text, SPACE, " "))


def normalize_search(q) -> Column:
    """The prefix rule, 22 shells in order, punctuation to spaces; the
    stripped input if nothing is left."""
    base = strip(q)
    return F.coalesce(blank_to_null(_shells_off(F.regexp_replace(base, "(?U)^上海话[：:]\\s*", ""), W.SEARCH_SHELLS)), base)


def normalize_shared(q) -> Column:
    """14 shells, no prefix rule."""
    base = strip(q)
    return F.coalesce(blank_to_null(_shells_off(base, W.SHARED_SHELLS)), base)


def normalize_rules(q) -> Column:
    """Suffix shells in order, all white space out, punctuation trimmed."""
    text = reduce(lambda c, s: F.regexp_replace(c, s + "$", ""), W.RULE_SUFFIXES, strip(q))
    return F.regexp_replace(F.regexp_replace(text, SPACE, ""), "^[，。！？；： ]+|[，。！？；： ]+$", "")


#: T4's patterns
PREFIX_SHELL = "(?U)^(?:(?:那个|这个|嗯|呃|啊|就是|麻烦|麻烦你|请问|我想问下|我想问一下|帮我查一下|帮我看看|请帮我|帮我|想问下|想问一下|查一下)[\\s，,。.!！?？；;：:、]*)+"
SUFFIX_SHELLS = [
    "(?U)(用)?上海话(里)?(怎么|怎样|咋)(说|讲|表达|念)[？?。!！\\s]*$",
    "(?U)(怎么|怎样|咋)(用)?上海话(说|讲|表达|念)[？?。!！\\s]*$",
    "(?U)(怎么|怎样|咋)(说|讲|表达|念)[？?。!！\\s]*$",
    "(?U)(是什么意思|啥意思|什么叫)[？?。!！\\s]*$",
]
EDGE = "[\\s，,。.!！？?；;：:、\"'“”‘’（）()\\[\\]【】]+"


def clean_query(q) -> Column:
    """T4: prefix shells to the fixpoint, suffix shells, white space and
    punctuation at the ends; the stripped input if nothing is left."""
    base = strip(F.coalesce(_col(q), F.lit("")))
    core = reduce(lambda c, p: F.regexp_replace(c, p, ""), SUFFIX_SHELLS, F.regexp_replace(base, PREFIX_SHELL, ""))
    core = F.regexp_replace(F.regexp_replace(core, SPACE, ""), f"(?U)^{EDGE}|{EDGE}$", "")
    return F.coalesce(blank_to_null(core), base)


def squeeze(x) -> Column:
    """T5: all white space out."""
    return F.regexp_replace(_col(x), SPACE, "")


def headword_edges(x) -> Column:
    """Brackets and spaces off both ends."""
    return F.regexp_replace(_col(x), "^[【】\\[\\] ]+|[【】\\[\\] ]+$", "")


def headword_everywhere(x) -> Column:
    """Brackets and white space out anywhere."""
    return F.regexp_replace(_col(x), "(?U)[\\[\\]【】\\s]", "")


def headword_numbered(x) -> Column:
    """Opening brackets, then closing ones with a ``.digits`` mark."""
    text = F.regexp_replace(strip(x), "^[\\[【]+", "")
    text = F.regexp_replace(text, "[\\]】]+\\.\\d+$", "")
    return strip(F.regexp_replace(text, "[\\]】]+$", ""))


def headword_nested(x) -> Column:
    """T6d: square brackets off the ends, then lenticular ones."""
    return F.regexp_replace(F.regexp_replace(strip(x), "^[\\[\\]]+|[\\[\\]]+$", ""), "^[【】]+|[【】]+$", "")


def definition_key(x) -> Column:
    """Sentence punctuation and white space out."""
    return F.regexp_replace(_col(x), "(?U)[。！？!?，,；;：:、\\s]+", "")


def definition_match(x) -> Column:
    """Markers out, text before the first separator, only CJK, letters and
    digits."""
    text = without(F.regexp_replace(strip(x), "〈[^〉]+〉", ""), ["﹝俚﹞", "﹝旧﹞"])
    return F.regexp_replace(F.split(text, "[：:；;。丨◇]")[0], "[^\\u4e00-\\u9fffA-Za-z0-9]", "")


def definition_pair(x) -> Column:
    """As T8 but 《…》 and ～ go too and commas stay."""
    text = F.regexp_replace(strip(x), "〈[^〉]+〉|《[^》]+》|﹝[^﹞]+﹞", "")
    return F.regexp_replace(F.split(F.replace(text, F.lit("～"), F.lit("")), "[：:；;。丨◇]")[0], "^[，, ]+|[，, ]+$", "")


def markup_off(x) -> Column:
    """〈…〉, quoted citations and everything after ◇ out."""
    text = F.regexp_replace(_col(x), "〈[^〉]*〉", "")
    return strip(F.regexp_replace(F.regexp_replace(text, "《[^》]*》[:：]?", ""), "(?s)◇.*$", ""))


def leading_marker_off(x) -> Column:
    """T11"""
    return strip(F.regexp_replace(_col(x), "^〈[^〉]*〉", ""))


def clean_cell(x) -> Column:
    """Trimmed; ``nan`` and null are empty."""
    text = strip(F.coalesce(_col(x), F.lit("")))
    return F.when(F.lower(text) == "nan", "").otherwise(text)


def first_filled(*columns) -> Column:
    """The first cell that is not blank or ``nan``, else empty."""
    return F.coalesce(*[blank_to_null(clean_cell(c)) for c in columns], F.lit(""))


def length_between(x, low: int, high: int) -> Column:
    """T14"""
    return F.length(_col(x)).between(low, high)


def chinese_like(x) -> Column:
    """At least half of the characters (and one) are CJK."""
    return F.regexp_count(_col(x), F.lit(CJK)) >= F.greatest(F.lit(1), F.floor(F.length(_col(x)) / 2))


def all_chinese(x) -> Column:
    """T16"""
    return _col(x).rlike(f"^{CJK}+$")


def is_heading(tags, pinyin, definition, head) -> Column:
    """Rows that head a section instead of being an entry."""
    return _col(tags).rlike("heading|non_entry") | ((clean_cell(pinyin) == "") & (clean_cell(definition) == "")) | _col(head).rlike("^[名动形副代数量连介助叹]词") | _col(head).rlike("^\\d\\d?、")


def good_pair(source, target) -> Column:
    """T18"""
    s, t = _col(source), _col(target)
    return F.length(s).between(2, 18) & F.length(t).between(1, 12) & (s != t) & s.rlike(CJK) & t.rlike(CJK)


def index_text(headword, definition, mode: str = "both") -> Column:
    """T21"""
    h, d = _col(headword), _col(definition)
    return {"headword": h, "definition": d, "both": F.concat(h, F.lit("。释义："), d)}[mode]


def source_alias(x, primary: str = "primary", second: str = "second") -> Column:
    """Known names of the two dictionaries; others pass."""
    low = F.lower(strip(F.coalesce(_col(x), F.lit(""))))
    return F.when(low.isin("", "primary", "default", "shanghai_csv"), primary).when(low.isin("second", "secondary") | low.endswith("_xlsx"), second).otherwise(low)


def route(x) -> Column:
    """What a chat message asks for."""
    text = _col(x)
    return F.when(text.contains("再读一遍"), "repeat").when(text.contains("下载"), "download").when(text.rlike("^[a-zA-Z0-9\\s]+$"), "latin").when(text.rlike("[\\[【][^\\]】]+[\\]】]"), "bracketed").otherwise("lookup")


def translation_cleanup(x) -> Column:
    """Label off, cut at the end token, first filled line, quotes off."""
    text = F.regexp_replace(strip(x), "^(?:译文|翻译|输出|答案)\\s*[：:]\\s*", "")
    text = F.split(text, "<\\|im_end\\|>|</s>")[0]
    line = F.get(F.filter(F.transform(F.split(text, "\n"), strip), lambda y: y != ""), F.lit(0))
    return F.regexp_replace(F.coalesce(line, F.lit("")), "^[\"'“”‘’]+|[\"'“”‘’]+$", "")


def html_escape(x) -> Column:
    """The five special characters."""
    text = _col(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
