"""Small literal tables with CJK rows, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "fx_entries": (
        "id long, headword string, definition string, pinyin string, notes string",
        [
            (0, "【开心】", "〈形〉高兴，快乐。", "khe sin", "常用"),
            (1, "【困觉】", "睡觉：夜里～。◇ 旧小说", "khuen koh", ""),
            (3, "【吃】", "吃，喝。", "chiq", "也说“喫”"),
            (4, "[讲闲话]", "说话；聊天。", "kaon ghe gho", "nan"),
            (5, "【相骂】.2", "吵架。丨相打", "sian mo", ""),
            (7, "【开心】", "心情好。", "khe sin", "重出"),
            (8, "【今朝】", "今天。", "cin tsau", ""),
            (9, "【明朝】", "明天。", "min tsau", ""),
            (10, "【辰光】", "﹝旧﹞时候；时间。", "zen kuaon", ""),
            (11, "【侪】", "都，全部。", "ze", ""),
            (12, "【适意】", "舒服。", "seq i", ""),
            (13, "【趣】", "漂亮，好看。", "tshy", ""),
            (15, "【勿来】", "不行。", "veq le", ""),
            (16, "【𠲎】", "〈助〉吗。", "va", ""),
            (17, "【汏衣裳】", "洗衣服：伊拉～。", "da i zaon", "nan"),
            (18, "【睏】", "睡觉。", "khuen", ""),
            (19, "nan", " ", "", ""),
            (20, "【讲张】", "聊天。", "kaon tsan", ""),
            (21, "small ring 小环", "a small ring", "", ""),
            (22, "【邪气】", "很；非常。", "zia chi", ""),
        ],
    ),
    "fx_queries": (
        "qid long, text string",
        list(
            enumerate(
                [
                    "开心用上海话怎么说", "上海话：睡觉怎么讲", "请问聊天怎么说？", "今天怎么表达", "适意是什么意思", "啥意思", "我想问下吵架上海话怎么讲", "我们爱你", "我爱你", "讲不来", "对不住 做不来",
                    "small ring 怎么说", "　开心　啊", "！？。", "", "麻烦麻烦请帮我查一下，漂亮怎么说", "不舒服怎么用上海话讲", "夸人聪明", "洗衣服用上海话怎么讲", "今天天气 明天下雨 后天放晴怎么说", "很好看吗", "到底要不要睡觉呢",
                    "怎么说开心", "时候这个词", "不不不不",
                ]
            )
        ),
    ),
    "fx_parsed": (
        "qid long, query string, core_text string, type string, predicate string, object string, segments array<string>, keywords array<string>",
        [
            (0, "开心怎么说", "开心", "词项", "", "", ["开心"], ["开心"]),
            (1, "洗衣服怎么说", "洗衣服", "动作短语", "洗", "衣服", ["洗", "衣服"], ["洗", "衣服", "洗"]),
            (2, "我爱你", "我爱你", "动作短语", "爱", "你", ["我", "爱", "你"], ["爱", "abc", "我"]),
            (3, "睡觉", "睡觉怎么说", "动词", "", "", ["睡觉"], ["睡觉"]),
            (4, "", "", "词项", "", "", [], []),
            (5, "吃饭喝酒", "吃饭喝酒", "动作短语", "", "酒", ["吃饭", "喝酒"], ["吃饭", "喝酒", "饭", "酒", "吃", "喝"]),
            (6, "说明书", "说明书", "词项", "看", "书", ["说明书"], ["说明", "书"]),
            (7, "难受", "难受", "动作短语", "难", "受", ["难受"], ["难受"]),
        ],
    ),
    "fx_teacher": (
        "batch_index long, batch_queries array<string>, raw_response string",
        [
            (0, ["开心", "睡觉"], '[{"query":"开心","core_text":"开心","type":"词项"},{"query":"睡觉","core_text":"睡觉","type":"词项"}]'),
            (1, ["聊天"], '{"query":"聊天","core_text":"聊天","type":"词项"}'),
            (2, ["吃饭"], '好的：[{"query":"吃饭","core_text":"吃饭","type":"动作短语"}] 完'),
            (3, ["坏"], "[{bad json]"),
            (4, ["漏"], '[{"core_text":"漏","type":"词项"}]'),
            (5, ["开心"], '[{"query":"开心","core_text":"开心2","type":"动作短语"}]'),
            (6, ["无"], "没有结果"),
        ],
    ),
    "fx_tags": (
        "id long, text string, gold array<string>, pred array<string>",
        [
            (0, "开心", ["B", "E"], ["B", "E"]),
            (1, "洗衣服", ["S", "B", "E"], ["B", "M", "E"]),
            (2, "我爱你", ["S", "S", "S"], ["S", "B", "E"]),
            (3, "讲闲话", ["S", "B", "E"], ["S", "B", "E"]),
            (4, "今朝吃饭", ["B", "E", "B", "E"], ["B", "E", "S", "B"]),
            (5, "趣", ["S"], ["E"]),
            (6, "相骂", ["B", "E"], ["M", "S"]),
        ],
    ),
    "fx_tokens": (
        "id long, sentence string, tokens array<string>, token_tags array<string>, tone_domain_ids array<long>",
        [
            (0, "我吃饭", ["我", "吃饭"], ["R", "V"], [0, 1]),
            (1, "我吃饭", ["我", "饭"], ["R", "N"], [0, 1]),
            (2, "我吃饭", ["我", "吃", "饭"], ["R", "V"], [0, 1, 2]),
            (3, "我吃饭", ["我", "吃饭"], ["R", "ZZ"], [0, 1]),
            (4, "我吃饭", ["我", "吃饭"], ["R", "V"], [0]),
            (5, "我吃饭", ["我", "吃饭"], ["R", "V"], [1, 0]),
            (6, "", [], [], []),
            (7, "我吃饭", [], [], []),
            (8, "好", ["好"], ["A"], [3]),
        ],
    ),
    "fx_lexicon": (
        "ord long, word string, tags string",
        [(0, "今|朝", "N"), (1, "我", "R"), (2, "我伲", "R"), (3, "吃", "V"), (4, "吃饭", "V/N"), (5, "饭", "N"), (6, "今朝", "T+N"), (7, "辰光", "N"), (8, "讲", "V"), (9, "讲闲话", "V"), (10, "闲话", "N"), (11, "好", "A/V"), (12, "吃", "N+XX")],
    ),
    "fx_sentences": ("id long, sentence string", [(0, "我今朝吃饭。"), (1, "我伲讲闲话"), (2, "好辰光，好！"), (3, "吃吃饭饭"), (4, ""), (5, "未知字")]),
    "fx_sets": ("id long, gold array<string>, pred array<string>", [(0, ["a", "b"], ["b", "c"]), (1, [], []), (2, ["a"], []), (3, [], ["a"]), (4, ["a", "b", "c"], ["a", "b", "c"]), (5, ["a"], ["a", "b", "c", "d"])]),
    "fx_vec": ("id long, v array<double>", [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.6, 0.8]), (4, [0.8, 0.6]), (5, [0.0, 0.0]), (6, [3.0, 4.0]), (7, [1.0, 0.0])]),
    "fx_cells": ("id long, a string, b string, c string", [(0, " x ", "y", "z"), (1, "nan", "", "z"), (2, None, " NaN ", " "), (3, "", "b", None)]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(value, kind: str) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        inner = "[" + ", ".join(_literal(v, "") for v in value) + "]"
        types = {"array<string>": "VARCHAR[]", "array<long>": "BIGINT[]", "array<double>": "DOUBLE[]"}
        return f"{inner}::{types[kind]}"
    return f"{value}::BIGINT" if kind == "long" else str(value)


def sql(name: str) -> str:
    """The same rows as a SQL table expression."""
    schema, rows = TABLES[name]
    columns = [part.strip().split(" ") for part in schema.split(",")]
    body = ", ".join("(" + ", ".join(_literal(v, k) for v, (_, k) in zip(row, columns)) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS {name}({', '.join(n for n, _ in columns)}))"
