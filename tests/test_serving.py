"""Responder source, versioned index, windows, memo, coverage, line sources."""

import json
import os
import threading
from collections import OrderedDict
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import grams
from corpusloom.sources import responder, tables, versioned
from corpusloom.streaming import coverage, memo, windows

# -- responder ---------------------------------------------------------------------


def no_sleep(_):
    pass


def test_ask_retries_then_falls_back():
    seen, slept = [], []

    def call(model, request, attempt):
        seen.append((model, attempt))
        if model == "a":
            raise TimeoutError("slow")
        return "yes" if attempt else (_ for _ in ()).throw(OSError("gone"))

    out = responder.ask({"batch_index": 1}, call, ["a", "b"], 3, slept.append)
    assert seen == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)] and slept == [1.5, 3.0, 1.5]
    assert (out["teacher_model"], out["raw_response"], out["error"], out["calls"], out["waited_s"]) == ("b", "yes", None, 5, 6.0)


def test_ask_blank_and_failed():
    blank = responder.ask({}, lambda *a: " ", ["a", "b"], 3, no_sleep)
    assert (blank["teacher_model"], blank["error"], blank["calls"]) == ("b", responder.NO_TEXT, 2)
    failed = responder.ask({}, lambda *a: (_ for _ in ()).throw(KeyError("k")), ["a"], 2, no_sleep)
    assert failed["teacher_model"] == "a" and failed["error"] == "KeyError: 'k'" and failed["calls"] == 2
    assert [responder.back_off(i) for i in (0, 1, 5, 9)] == [1.5, 3.0, 8.0, 8.0]


def test_a_killed_run_resumes_without_calling_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = asked["messages"][1]["content"].splitlines()[1]
            (calls / f"{datetime.now().timestamp()}-{id(asked)}").write_text(text)
            body = json.dumps({"choices": [{"message": {"content": f"answer to {text}"}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    asked = lambda: sorted(p.read_text() for p in calls.iterdir())
    try:
        make = lambda numbers: spark.createDataFrame([(i, [f"q{i}"], ["s"]) for i in numbers], "batch_index bigint, batch_queries array<string>, batch_sources array<string>").repartition(2)
        ledger = f"{tmp_path}/ledger"
        responder.make_ledger(make(range(6)), ledger, per_file=2)
        options = {"model": "m", "caller": "http", "api_base": f"http://127.0.0.1:{server.server_port}", "pace": "0"}
        run = lambda out, checkpoint: responder.answers(spark, ledger, f"{tmp_path}/{out}", f"{tmp_path}/{checkpoint}", **options).awaitTermination()
        run("lost", "lost-checkpoint")
        assert asked() == [f"1. q{i}" for i in range(6)]
        # the output and its checkpoint are lost, as when the driver dies before
        # the batch is committed: the kept answers are read, nothing is called
        run("out", "checkpoint")
        assert len(asked()) == 6
        responder.make_ledger(make(range(4, 9)), ledger, number=1)  # 4 and 5 are answered
        run("out", "checkpoint")
        assert asked() == [f"1. q{i}" for i in range(9)]
        got = spark.read.schema(responder.DDL).parquet(f"{tmp_path}/out").collect()
        assert sorted((r["batch_index"], r["raw_response"], r["calls"]) for r in got) == [(i, f"answer to 1. q{i}", 1) for i in range(9)]
    finally:
        server.shutdown()


def test_files_per_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, [f"q{i}"], ["s"]) for i in range(4)], "batch_index bigint, batch_queries array<string>, batch_sources array<string>").coalesce(1)
    responder.make_ledger(rows, f"{tmp_path}/l", per_file=1)
    reader = responder.ResponderReader({"ledger": f"{tmp_path}/l", "model": "m", "files_per_batch": "3", "pace": "0"})
    assert reader.initialOffset() == {"files": 0} and reader.latestOffset() == {"files": 3}
    for file in reader.partitions({"files": 0}, {"files": 3}):
        (batch,) = reader.read(file)
        assert batch.to_pylist()[0]["error"] == "RuntimeError: no_reply"
    # a reader that starts anew goes on behind the files that have answers
    again = responder.ResponderReader(reader.options)
    assert again.latestOffset() == {"files": 4} and len(again.partitions({"files": 3}, {"files": 4})) == 1


# -- versions -----------------------------------------------------------------------

ENTRY = "id bigint, headword string, definition string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_stop_between_write_and_swap(spark, tmp_path, monkeypatch):
    index = versioned.VersionedTable(spark, f"{tmp_path}/index")
    assert index.read().count() == 0
    index.rebuild(spark.createDataFrame([(1, "a", "x")], ENTRY))

    def stop(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(versioned.VersionedTable, "_commit", stop)
    with pytest.raises(KeyboardInterrupt):
        index.rebuild(spark.createDataFrame([(1, "b", "y")], ENTRY))
    monkeypatch.undo()
    assert rows_of(index.read()) == [(1, "a", "x")] and index.version()[0] == 1
    assert index.rebuild(spark.createDataFrame([(1, "b", "y")], ENTRY)) == 2
    assert rows_of(index.read()) == [(1, "b", "y")] and rows_of(index.read(1)) == [(1, "a", "x")]


def test_a_lock_left_behind_is_taken_over(spark, tmp_path):
    index = versioned.VersionedTable(spark, f"{tmp_path}/index", stale_s=60)
    index._put("lock", {"writer": "dead", "at": datetime.now().timestamp()})
    with pytest.raises(versioned.AlreadyRunning):
        index.rebuild(spark.createDataFrame([(1, "a", "x")], ENTRY))
    index.stale_s = 0
    assert index.rebuild(spark.createDataFrame([(1, "a", "x")], ENTRY)) == 1


def test_racing_rebuilds_leave_one_version(spark, tmp_path):
    outcome = []

    def work(name):
        index = versioned.VersionedTable(spark, f"{tmp_path}/index")
        try:
            outcome.append(index.rebuild(spark.range(200_000).select("id", F.lit(name).alias("headword"), F.lit("").alias("definition"))))
        except versioned.AlreadyRunning:
            outcome.append(None)

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    index = versioned.VersionedTable(spark, f"{tmp_path}/index")
    assert sorted(outcome, key=str) == [1, None] and index.version()[0] == 1
    assert index.read().select("headword").distinct().count() == 1 and index.read().count() == 200_000
    steps = [r["step"] for r in index.status().orderBy("at").collect()]
    assert steps == ["started", "writing", "written", "done"] and not index.running()


def test_patches(spark, tmp_path):
    index = versioned.VersionedTable(spark, f"{tmp_path}/index")
    index.rebuild(spark.createDataFrame([(4, "a", "x")], ENTRY))
    new = spark.createDataFrame([(1, "a", "no"), (2, "b", "second"), (1, "b", "first"), (3, None, "no"), (0, "c", "y")], "ord int, headword string, definition string")
    assert index.patch(new, batch="k/0") == 2
    assert rows_of(index.read()) == [(4, "a", "x"), (5, "c", "y"), (6, "b", "first")]
    assert index.patch(new, batch="k/0") == 2 and index.patch(new) == 2
    assert index.patch(new.withColumn("headword", F.lit("d")), batch="k/1") == 3 and index.read().count() == 4


def test_follow_a_stream(spark, tmp_path):
    for number, word in enumerate(("a", "b", "a")):
        spark.createDataFrame([(number, word, f"from {number}")], "ord int, headword string, definition string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    index = versioned.VersionedTable(spark, f"{tmp_path}/index")
    stream = spark.readStream.schema("ord int, headword string, definition string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    index.follow(stream, f"{tmp_path}/checkpoint").awaitTermination()
    assert {(r["id"], r["headword"]) for r in index.read().collect()} == {(0, "a"), (1, "b")} and index.version()[0] == 3


def test_discover_and_describe(spark, tmp_path):
    root = f"{tmp_path}/indexes"
    assert versioned.discover(spark, root) == [] and versioned.describe(spark, root).count() == 0
    for name in ("second", "primary"):
        versioned.VersionedTable(spark, f"{root}/{name}").rebuild(spark.createDataFrame([(1, "a", "x")], ENTRY))
    (tmp_path / "indexes" / "unfinished").mkdir()
    got = [(r["name"], r["version"], r["folders"], r["running"], r["is_default"]) for r in versioned.describe(spark, root).collect()]
    assert got == [("primary", 1, 1, False, True), ("second", 1, 1, False, False)]


def test_whole_groups_never_straddle(spark, sf):
    from corpusloom.plans import labelling

    got = labelling.p15_whole(spark, sf)
    assert got.groupBy("headword").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    assert got.select("part").distinct().count() == 3


# -- grams ---------------------------------------------------------------------------


def test_keyword_filter_against_every_pair(spark):
    texts = ["red widget of brass", "blue bolt", "", None, "a red bolt", "brass", "Red", "long text about widgets and brass fittings", "a red bolt"]
    t = spark.createDataFrame([(i, 100 - i, x) for i, x in enumerate(texts)], "id int, ord int, text string")
    asked = {1: ["red", "brass fit"], 2: ["widget"], 3: [], 4: ["none such"], 5: None, 6: ["", None], 7: ["b", "of brass"], 8: ["RED"]}
    q = spark.createDataFrame(list(asked.items()), "qid int, keywords array<string>")
    want = set()
    for qid, words in asked.items():
        words = [w for w in words or [] if w]
        hit = [i for i, x in enumerate(texts) if not words or (x is not None and any(w in x for w in words))]
        want |= {(qid, i, r + 1) for r, i in enumerate(sorted(hit, key=lambda i: 100 - i)[:3])}
    assert {tuple(r) for r in grams.keyword_filter(q, t, 3).collect()} == want
    plan = grams.keyword_filter(q.where("qid in (1, 2)"), t, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_nothing_asked(spark):
    t = spark.createDataFrame([(1, 1, "x")], "id int, ord int, text string")
    q = spark.createDataFrame([], "qid int, keywords array<string>")
    assert grams.keyword_filter(q, t).count() == 0
    assert grams.keyword_filter(spark.createDataFrame([(1, ["x"])], q.schema), t.where("false")).count() == 0


# -- windows --------------------------------------------------------------------------


def stream_of(spark, path, batches):
    schema = "user_id int, ts timestamp, value double"
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{number:02d}")
        for f in os.listdir(f"{path}/{number:02d}"):
            os.utime(f"{path}/{number:02d}/{f}", (1_700_000_000 + number, 1_700_000_000 + number))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


@pytest.mark.parametrize("kind", ["sessions", "windows"])
def test_stream_equals_batch_but_for_late_rows(spark, tmp_path, kind):
    day = datetime(2024, 1, 1)
    at = lambda m: day + timedelta(minutes=m)
    on_time = [[(1, at(0), 1.0), (1, at(20), 2.0), (2, at(10), 4.0)], [(1, at(55), 8.0), (2, at(300), 16.0), (1, None, 9.0)], [(2, at(320), 32.0), (1, at(400), 64.0)]]
    late = (1, at(5), 1000.0)  # its window closed when at(300) was seen
    end = [[(9, at(5000), 0.0)], [(9, at(9000), 0.0)]]
    make = {"sessions": lambda df: windows.sessions(df, "ts", ["user_id"], "30 minutes", "value", "40 minutes"), "windows": lambda df: windows.windows(df, "ts", ["user_id"], "1 hour", "30 minutes", "value", "40 minutes")}[kind]
    batches = [*on_time, [late], *end]
    windows.start(make(stream_of(spark, f"{tmp_path}/in", batches)), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    table = spark.createDataFrame([r for b in on_time for r in b], "user_id int, ts timestamp, value double")
    got = [r for r in rows_of(spark.read.parquet(f"{tmp_path}/out")) if r[0] != 9]
    assert got == rows_of(make(table)) and got


# -- memo -----------------------------------------------------------------------------


def test_memo_computes_once_within_its_window(spark, tmp_path):
    texts = [list("abcabdaxbcae"), list("efabghae") + [None, None], list("axyzabc")]
    for number, batch in enumerate(texts):
        rows = [(number * 100 + i, x) for i, x in enumerate(batch)]
        spark.createDataFrame(rows, "row_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{number:02d}")
        for f in os.listdir(f"{tmp_path}/in/{number:02d}"):
            os.utime(f"{tmp_path}/in/{number:02d}/{f}", (1_700_000_000 + number, 1_700_000_000 + number))

    def spell(text, folder=str(tmp_path)):
        with open(f"{folder}/calls", "a") as f:
            f.write(f"{text}\n")
        return f"<{text}>"

    before = spark.conf.get(memo.STORE)
    spark.conf.set(memo.STORE, memo.ROCKS)
    try:
        stream = spark.readStream.schema("row_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = memo.remembered(stream, spell, capacity=4, shards=1)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(memo.STORE, before)
    held, want, calls = OrderedDict(), {}, []
    for number, batch in enumerate(texts):
        for i, x in enumerate(batch):
            want[number * 100 + i] = (f"<{x}>", x in held)
            if x in held:
                held.move_to_end(x)
            else:
                calls.append(str(x))
                if len(held) == 4:
                    held.popitem(last=False)
                held[x] = True
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r["row_id"]: (r["result"], r["remembered"]) for r in got} == want
    assert sorted((tmp_path / "calls").read_text().split("\n")[:-1]) == sorted(calls)


# -- coverage ---------------------------------------------------------------------------


def test_until_covered(spark, tmp_path):
    put = lambda n: spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/in/{n:02d}")
    put(0)
    paused = []

    def start():
        rows = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in/*")
        return rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()

    def fill(_):
        paused.append(1)
        put(len(paused))

    assert coverage.until_covered(spark, start, 25, sleep=fill) == 30 and len(paused) == 2
    assert coverage.until_covered(spark, start, 25, lambda: spark.read.parquet(f"{tmp_path}/out").count()) == 30
    assert coverage.until_covered(spark, start, 99, lambda: 1, sleep=lambda s: None, rounds=2) == 1


# -- lines --------------------------------------------------------------------------------


@pytest.fixture
def split_files(spark, tmp_path):
    lines = [[f'{{"a": {i}, "t": "{"x" * (i % 50)}"}}' if i % 9 else "" for i in range(3000)], [f'{{"a": {i}}}' for i in range(500)]]
    for n, ls in enumerate(lines):
        (tmp_path / f"f{n}.jsonl").write_text(("﻿" if n else "") + "\n".join(ls) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    yield str(tmp_path), lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_numbers_over_splits(spark, split_files):
    path, lines = split_files
    got = tables.numbered_lines(spark, path)
    assert spark.read.text(path).rdd.getNumPartitions() > 4
    want = [(n, i + 1) for n, ls in enumerate(lines) for i in range(len(ls))]
    rows = sorted(got.collect(), key=lambda r: r["n"])
    assert [(int(r["file"][-7]), r["line"]) for r in rows] == want and [r["n"] for r in rows] == list(range(len(want)))
    assert [r["value"].lstrip("﻿") for r in rows] == [x for ls in lines for x in ls]
    full = [x for ls in lines for x in ls if x]
    assert [r["value"].lstrip("﻿") for r in tables.head_lines(spark, path, 2700).orderBy("n").collect()] == full[:2700]


def test_malformed_line_is_fatal_with_its_place(spark, split_files):
    path, lines = split_files
    assert tables.read_jsonl_strict(spark, path, "a int, t string").count() == sum(bool(x) for ls in lines for x in ls)
    assert tables.read_jsonl_strict(spark, path, "a int, t string").agg(F.sum("a")).first()[0] == sum(json.loads(x)["a"] for ls in lines for x in ls if x)
    with open(f"{path}/f0.jsonl") as f:
        text = f.read().split("\n")
    text[2500] = '{"a": 1'
    with open(f"{path}/f0.jsonl", "w") as f:
        f.write("\n".join(text))
    with pytest.raises(Exception, match=r"f0\.jsonl:2501: not a JSON object"):
        tables.read_jsonl_strict(spark, path, "a int, t string").agg(F.sum("a")).collect()
    rows, seen = tables.read_jsonl_lenient(spark, path, "a int, t string")
    assert rows.count() == sum(bool(x) for ls in lines for x in ls) - (1 if lines[0][2500] else 0)
    assert seen.get["malformed"] == 1 and seen.get["lines"] == 3500
