"""Joining and choosing tags of segmented sentences."""

from corpusloom.operators import segmentation


def test_tag(spark):
    rows = [
        (1, [("我", ["R"]), ("讲", ["V", "N"]), ("闲话", ["N", "V"])]),  # V after R, N after V
        (2, [("台子", ["N"]), ("头里", ["ND"]), ("个", ["SP"]), ("书", ["N"])]),
        (3, [("个", ["SP"]), ("头里", ["N"])]),
        (4, [("好", ["A", "N"]), ("三", ["M"]), ("走", ["V", "A"]), ("红", ["A", "N"]), ("框", ["N", "FW"])]),
        (5, [("讲", ["V", "N"]), ("a", ["X", "Y"])]),
        (6, [("书", ["N"]), ("个", ["SP"]), ("里向", ["ND"])]),
    ]
    flat = [(i, k, w, t) for i, line in rows for k, (w, t) in enumerate(line)]
    df = spark.createDataFrame(flat, "id long, pos long, token string, tags array<string>").repartition(3)
    got = {r["id"]: r["annotation"] for r in segmentation.tag(df).collect()}
    assert got == {1: "我/R#讲/V#闲话/N", 2: "台子头里个/ND#书/N", 3: "个/SP#头里/N", 4: "好/N#三/M#走/V#红/A#框/FW", 5: "讲/V#a/X", 6: "书个/N#里向/ND"}
