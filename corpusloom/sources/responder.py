"""A remote model as a streaming source of answers.

``make_ledger`` writes the requests (batches of queries) as numbered folders of
files; the source's offset is the number of files taken. A partition is one
file: its requests are sent with a cap on calls in flight, a pause between
launches, retries with linear back-off and, where the model has no answer, a
second model. Which function makes a call is an option: ``replay`` finds the
answer in the request (for tests and repeated runs), ``http`` posts it.

A file's answers are kept beside the ledger as soon as its last call is back,
under the file's name. A batch that Spark runs again after a failure, a killed
run, and a second copy of a task read them instead of calling again, so only
calls that were under way when a task was lost are made twice.

Edge cases: an empty file gives no rows; a request whose every answer is blank
or failed is a row with the last error; null and repeated queries stay as they
are; the files are read through pyarrow's file systems, so the ledger has to be
in a folder that executors share.
"""

from __future__ import annotations

import json
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

ANSWERS = pa.schema([("batch_index", pa.int64()), ("batch_queries", pa.list_(pa.string())), ("batch_sources", pa.list_(pa.string())), ("teacher_model", pa.string()), ("raw_response", pa.string()), ("error", pa.string()), ("calls", pa.int32()), ("waited_s", pa.float64())])
DDL = "batch_index bigint, batch_queries array<string>, batch_sources array<string>, teacher_model string, raw_response string, error string, calls int, waited_s double"
NO_TEXT = "teacher_response_has_no_text"
#: fixed value: the line above the numbered queries
HEADER = "请逐条标注以下查询，并按原顺序返回 JSON 数组："


def back_off(attempt: int) -> float:
    """Seconds before the attempt after this one (from 0)."""
    return min(8.0, 1.5 * (attempt + 1))


def replay(options: dict) -> Callable[[str, dict, int], str]:
    """Calls answered from the request's own ``replies``."""

    def call(model: str, request: dict, attempt: int) -> str:
        for r in request["replies"] or []:
            if r["model"] == model and r["attempt"] == attempt:
                if r["error"] is not None:
                    raise RuntimeError(r["error"])
                return r["text"]
        raise RuntimeError("no_reply")

    return call


def http(options: dict) -> Callable[[str, dict, int], str]:
    """Calls by POST to ``api_base``/chat/completions."""

    def call(model: str, request: dict, attempt: int) -> str:
        lines = "\n".join(f"{i + 1}. {q}" for i, q in enumerate(request["batch_queries"]))
        messages = [{"role": "system", "content": options.get("system", "")}, {"role": "user", "content": f"{HEADER}\n{lines}"}]
        body = {"model": model, "messages": messages, "temperature": float(options.get("temperature", 0)), "max_tokens": int(options.get("max_tokens", 1024))}
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {options.get('api_key', '')}"}
        post = urllib.request.Request(f"{options['api_base']}/chat/completions", json.dumps(body).encode(), head)
        with urllib.request.urlopen(post, timeout=float(options.get("timeout_s", 120))) as got:
            message = json.load(got)["choices"][0]["message"]
        return message.get("content") or message.get("reasoning_content") or message.get("reasoning") or ""

    return call


CALLERS = {"replay": replay, "http": http}


def ask(request: dict, call: Callable[[str, dict, int], str], models: list[str], retries: int, sleep: Callable[[float], None]) -> dict:
    """One request to the models in turn: a model is tried until a call
    returns, and left if what it returned is blank."""
    used, text, error, calls, waited = models[0], None, "", 0, 0.0
    for model in models:
        for attempt in range(retries):
            calls += 1
            try:
                text, used = call(model, request, attempt), model
                break
            except Exception as problem:  # noqa: BLE001  a call may fail in any way; the row says how
                error = f"{type(problem).__name__}: {problem}"
                if attempt + 1 < retries:
                    waited += back_off(attempt)
                    sleep(back_off(attempt))
        if text and text.strip():
            return request | {"teacher_model": used, "raw_response": text, "error": None, "calls": calls, "waited_s": waited}
    return request | {"teacher_model": used, "raw_response": None, "error": error or NO_TEXT, "calls": calls, "waited_s": waited}


class LedgerFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ResponderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.system, self.root = fs.FileSystem.from_uri(options["ledger"])
        self.limit = int(options.get("files_per_batch", 1 << 30))

    def __getstate__(self):
        return {"options": self.options}

    def __setstate__(self, state):
        self.__init__(state["options"])

    # -- on the driver: offsets are numbers of ledger files

    def files(self) -> list[str]:
        found = self.system.get_file_info(fs.FileSelector(f"{self.root}/requests", recursive=True))
        return sorted(f.path for f in found if f.base_name.startswith("part-") and f.size)

    def kept(self, path: str) -> str:
        return f"{self.root}/answers/{path.removeprefix(f'{self.root}/requests/').replace('/', '-')}"

    def answered_files(self) -> int:
        """Ledger files before the first one that has no answers yet."""
        files, have = self.files(), {f.path for f in self.system.get_file_info(fs.FileSelector(f"{self.root}/answers", allow_not_found=True))}
        return next((n for n, f in enumerate(files) if self.kept(f) not in have), len(files))

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": min(len(self.files()), self.answered_files() + self.limit)}

    def partitions(self, start: dict, end: dict) -> list[LedgerFile]:
        return [LedgerFile(f) for f in self.files()[start["files"] : end["files"]]]

    def commit(self, end: dict) -> None:
        """Nothing to do: requests and answers stay, as the record of the calls."""

    # -- in tasks

    def read(self, partition: LedgerFile) -> Iterator[pa.RecordBatch]:
        kept = self.kept(partition.path)
        if self.system.get_file_info(kept).type == fs.FileType.NotFound:
            with self.system.open_input_file(partition.path) as f:
                requests = pq.read_table(f).to_pylist()
            answers = pa.Table.from_pylist(self.answered(requests), ANSWERS)
            self.system.create_dir(f"{self.root}/answers")
            replaced(self.system, kept, lambda f: pq.write_table(answers, f))
        with self.system.open_input_file(kept) as f:
            yield from pq.read_table(f, schema=ANSWERS).to_batches()

    def answered(self, requests: list[dict]) -> list[dict]:
        o = self.options
        call = CALLERS[o.get("caller", "replay")](o)
        pace = float(o.get("pace", 1))  # 0: no waiting, as for answers that are at hand
        models = [m for m in (o["model"], o.get("fallback_model")) if m]
        with ThreadPoolExecutor(int(o.get("max_in_flight", 4))) as pool:
            out = []
            for number, request in enumerate(requests):
                if number:
                    time.sleep(pace * float(o.get("launch_interval_s", 0)))
                out.append(pool.submit(ask, request, call, models, int(o.get("max_retries", 3)), lambda s: time.sleep(pace * s)))
            return [{k: r.result()[k] for k in ANSWERS.names} for r in out]


def replaced(system: fs.FileSystem, path: str, write: Callable) -> None:
    """Write a file under another name and move it into place."""
    new = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(new) as f:
        write(f)
    system.move(new, path)


class Responder(DataSource):
    """Options: ledger, model, fallback_model, caller, max_retries,
    max_in_flight, launch_interval_s, pace, files_per_batch; those of ``http``."""

    @classmethod
    def name(cls) -> str:
        return "responder"

    def schema(self) -> str:
        return DDL

    def streamReader(self, schema) -> ResponderReader:
        return ResponderReader(dict(self.options))


def batches(queries: DataFrame, order: list[str], size: int, query: str = "query", source: str = "source") -> DataFrame:
    """Requests of ``size`` queries in order: batch_index, batch_queries, batch_sources."""
    from ..operators.corpus import numbered

    placed = numbered(queries, order).withColumn("batch_index", F.floor(F.col("n") / size).cast("long"))
    listed = placed.groupBy("batch_index").agg(F.sort_array(F.collect_list(F.struct("n", F.col(query).alias("q"), F.col(source).alias("s")))).alias("x"))
    return listed.select("batch_index", F.transform("x", lambda x: x["q"]).alias("batch_queries"), F.transform("x", lambda x: x["s"]).alias("batch_sources"))


def make_ledger(requests: DataFrame, ledger: str, per_file: int = 1000, number: int = 0) -> None:
    """Write requests (with ``replies`` for the replay caller) as folder
    ``number`` of the ledger; later folders have greater numbers. What the
    ledger's answers already hold is left out (the resume rule)."""
    spark = requests.sparkSession
    if "replies" not in requests.columns:
        requests = requests.withColumn("replies", F.lit(None).cast("array<struct<model:string,attempt:int,text:string,error:string>>"))
    out = requests.select("batch_index", "batch_queries", "batch_sources", "replies")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/answers")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        out = out.join(spark.read.schema(DDL).parquet(f"{ledger}/answers").where("error is null").select("batch_index").distinct(), "batch_index", "left_anti")
    out.write.option("maxRecordsPerFile", per_file).parquet(f"{ledger}/requests/{number:012d}")


def answers(spark: SparkSession, ledger: str, out: str, checkpoint: str, trigger: dict | None = None, **options):
    """Start the stream from the ledger to a table of answers."""
    spark.dataSource.register(Responder)
    rows = spark.readStream.format("responder").option("ledger", ledger).options(**options).load()
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
