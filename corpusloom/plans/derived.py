"""Rows that are put together from ``part``, and the text rules as SQL.

The tables hold no dialect entries, so every key of ``part`` picks pieces of the
fixed lists below. SQL and Spark pick by the same arithmetic.
"""

from __future__ import annotations

from ..functions import text as T
from ..functions import words as W

WORDS = ["开心", "没用", "很累", "夸人帅", "吃饭", "走路", "abc", "解释", "房子", "我们"]
BEFORE = ["", "请问", "麻烦 ", "那个，嗯", "上海话：", " 帮我查一下"]
AFTER = ["怎么说", "是什么意思", "", "用上海话怎么讲？", "  ！", "啥意思。"]
DEFINITIONS = ["〈名〉高兴；快乐", "《书》:旧事◇引申", "〈动〉～：吃饭。走路丨房子", "没有用处，nan", "﹝俚﹞好看、漂亮", "", "nan", "〈形〉开心"]
KINDS = ["词项", "动作短语", "动作短语", "其它"]
PREDICATES = ["", "吃", "夸", "x"]
OBJECTS = ["", "我", "饭", "帅", "路1"]


def pick(values: list[str], index: str) -> tuple[str, str]:
    """Spark and DuckDB text of the entry of a list at ``index`` modulo its length."""
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    at = f"({index}) % {len(values)} + 1"
    return f"element_at(array({listed}), cast({at} as int))", f"[{listed}][{at}]"


def both(columns: dict[str, tuple[str, str]]) -> tuple[list[str], str]:
    return [f"{c[0]} AS {n}" for n, c in columns.items()], ", ".join(f"{c[1]} AS {n}" for n, c in columns.items())


def joined(*parts: tuple[str, str]) -> tuple[str, str]:
    return f"concat({', '.join(p[0] for p in parts)})", f"concat({', '.join(p[1] for p in parts)})"


K_, D3, D5, D7, D11 = "p_partkey", *[f"cast(floor(p_partkey / {n}) as bigint)" for n in (3, 5, 7, 11)]
ROWS = {
    "message": joined(pick(BEFORE, K_), pick(WORDS, D5), pick(AFTER, D11)),
    "word": pick(WORDS, D5),
    "other": pick(WORDS, f"{D7} + 3"),
    "definition": pick(DEFINITIONS, D3),
    "tags": joined(pick(["N", "V+N", "A/V", "zz", " SP ", "R"], D7), ("''", "''")),
}
SPARK_ROWS, SQL_ROWS = both(ROWS)
BASE = f"SELECT p_partkey AS id, {SQL_ROWS} FROM part"


# -- the rules once more, as SQL --------------------------------------------------------

plain = lambda pattern: pattern.replace("(?U)", "").replace("\\u4e00-\\u9fff", "一-鿿")  # noqa: E731  in Spark's patterns (?U) is Unicode classes
quoted = lambda pattern: plain(pattern).replace("'", "''")
gsub = lambda x, pattern, new="": f"regexp_replace({x}, '{quoted(pattern)}', '{new}', 'g')"
trim = lambda x: gsub(x, "^\\s+|\\s+$")
or_else = lambda x, y: f"coalesce(nullif({x}, ''), {y})"
CJK = "[一-鿿]"


def without(x, parts):
    for p in parts:
        x = f"replace({x}, '{p}', '')"
    return x


def shells_off(x, shells):
    return trim(gsub(gsub(without(x, shells), "[\"'，,。.!！?？；;：:（）()\\[\\]【】]+", " "), "\\s+", " "))


def normalize_rules(x):
    x = trim(x)
    for s in W.RULE_SUFFIXES:
        x = gsub(x, s + "$")
    return gsub(gsub(x, "\\s+"), "^[，。！？；： ]+|[，。！？；： ]+$")


def clean_query(x):
    base = trim(f"coalesce({x}, '')")
    core = gsub(base, T.PREFIX_SHELL)
    for p in T.SUFFIX_SHELLS:
        core = gsub(core, p)
    return or_else(gsub(gsub(core, "\\s+"), f"^{T.EDGE}|{T.EDGE}$"), base)


def clean_cell(x):
    return f"CASE WHEN lower({trim(f"coalesce({x}, '')")}) = 'nan' THEN '' ELSE {trim(f"coalesce({x}, '')")} END"


grams_sql = lambda x, n: f"list_transform(range(1, greatest(length({x}) - {n - 1}, 0) + 1), lambda i: substr({x}, i, {n}))"
distinct = lambda xs: f"list_filter({xs}, lambda v, i: list_position({xs}, v) = i)"
listed = lambda xs: f"array_to_string({xs}, '|')"

ANSWER = {
    "query": (f"CASE WHEN {K_} % 37 = 0 THEN ' ' ELSE {joined(pick(WORDS, D5), pick(AFTER, K_))[0]} END", f"CASE WHEN {K_} % 37 = 0 THEN ' ' ELSE {joined(pick(WORDS, D5), pick(AFTER, K_))[1]} END"),
    "core_text": (f"CASE WHEN {K_} % 4 = 0 THEN '' ELSE {joined(pick(WORDS, D5), pick(AFTER, D7))[0]} END", f"CASE WHEN {K_} % 4 = 0 THEN '' ELSE {joined(pick(WORDS, D5), pick(AFTER, D7))[1]} END"),
    "type": pick(KINDS, D3),
    "predicate": pick(PREDICATES, D7),
    "object": pick(OBJECTS, D11),
    "keywords": (
        f"CASE WHEN {K_} % 41 = 0 THEN NULL ELSE array({pick(WORDS, D3)[0]}, {pick(WORDS, D5)[0]}, {pick(OBJECTS, D7)[0]}) END",
        f"CASE WHEN {K_} % 41 = 0 THEN NULL ELSE [{pick(WORDS, D3)[1]}, {pick(WORDS, D5)[1]}, {pick(OBJECTS, D7)[1]}] END",
    ),
}
SPARK_ANSWER, SQL_ANSWER = both(ANSWER)

# -- entries, queries and pairs of both ---------------------------------------------------

ENTRY = {
    "headword": joined(("'【'", "'【'"), pick(WORDS, D5), pick(WORDS, f"{D7} + 3"), ("'】'", "'】'")),
    "definition": joined(pick(DEFINITIONS, D3), ("p_name", "p_name"), ("'。'", "'。'"), ("p_type", "p_type")),
}
SPARK_ENTRY, SQL_ENTRY = both(ENTRY)
ENTRIES = f"SELECT p_partkey AS id, {SQL_ENTRY} FROM part"
TERM = joined(pick(WORDS, D5), pick(WORDS, f"{D7} + 3"), pick(["", "了", "吗"], D3))
#: Every key as a query meets the entries of the five keys up to it.
NEAR = 5
PAIRS = f"SELECT q.p_partkey AS qid, q.p_partkey - j AS id FROM part q, unnest(range({NEAR})) AS r(j) WHERE q.p_partkey >= j"
