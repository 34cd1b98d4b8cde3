"""An index table in versions: patched, rebuilt and read at the same time.

Data folders are written once and never changed. A version is a small file that
names the folders it is made of; it is written beside its place and renamed
there, which fails if the version exists. Readers take the last version, so
they see the old table or the new one. One writer at a time holds the lock file
(created without overwriting; ``stale_s`` after its last sign of life it may be
taken over, and a writer that has lost it can't commit). Each step of a writer
is one row of the status table.

Edge cases: before the first version the table is empty; a patch without new
keys makes no version; null keys are never new; of equal new keys the first by
``order`` counts; a micro-batch that is run again changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import first_per_key, numbered


class AlreadyRunning(RuntimeError):
    """Another writer holds the lock."""


def discover(spark: SparkSession, root: str, needed: tuple[str, ...] = ("versions", "data")) -> list[str]:
    """Names of the subfolders of ``root`` that hold everything ``needed``, sorted."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    whole = lambda p: all(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, n)) for n in needed)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and whole(s.getPath()))


def describe(spark: SparkSession, root: str, default: str = "primary") -> DataFrame:
    """Health of the indexes under ``root``: name, path, version, folders,
    running, is_default. Nothing of their data is read."""
    rows = []
    for name in discover(spark, root):
        index = VersionedTable(spark, f"{root}/{name}")
        number, content = index.version()
        rows.append((name, index.root, number, len(content["folders"]), index.running(), name == default))
    return spark.createDataFrame(rows, "name string, path string, version int, folders int, running boolean, is_default boolean")


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: str = "id bigint, headword string, definition string", stale_s: float = 3600):
        self.spark, self.root, self.schema, self.stale_s = spark, root.rstrip("/"), schema, stale_s
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- small files

    def _put(self, name: str, value: dict) -> bool:
        """Write a file that must not exist yet; whether it came into place."""
        new = self._path(f"{self.root}/_new/{uuid.uuid4().hex}")
        out = self.fs.create(new, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        at = self._path(f"{self.root}/{name}")
        self.fs.mkdirs(at.getParent())
        if self.fs.exists(at) or not self.fs.rename(new, at):
            self.fs.delete(new, False)
            return False
        return True

    def _get(self, name: str) -> dict | None:
        at = self._path(f"{self.root}/{name}")
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    # -- reading

    def version(self) -> tuple[int, dict]:
        """Number and content of the last version; (0, nothing) before the first."""
        names = self._names("versions")
        return (int(names[-1]), self._get(f"versions/{names[-1]}")) if names else (0, {"folders": [], "batches": []})

    def read(self, number: int | None = None) -> DataFrame:
        last, content = self.version()
        if number is not None and number != last:
            content = self._get(f"versions/{number:012d}")
        if not content["folders"]:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{f}" for f in content["folders"]])

    def status(self) -> DataFrame:
        """Steps of all writers so far: at, writer, step, detail."""
        rows = [self._get(f"status/{n}") for n in self._names("status")]
        return self.spark.createDataFrame([(r["at"], r["writer"], r["step"], r["detail"]) for r in rows], "at double, writer string, step string, detail string")

    def running(self) -> bool:
        lock = self._get("lock")
        return lock is not None and time.time() - lock["at"] < self.stale_s

    # -- writing

    def _say(self, writer: str, step: str, detail: str = "") -> None:
        self._put(f"status/{time.time_ns():020d}-{writer}", {"at": time.time(), "writer": writer, "step": step, "detail": detail})

    def _commit(self, writer: str, number: int, content: dict) -> int:
        lock = self._get("lock")
        if lock is None or lock["writer"] != writer or not self._put(f"versions/{number:012d}", content):
            raise AlreadyRunning(f"version {number} was made by another writer")
        return number

    def _write(self, what: str, make: Callable[[str], tuple[int, dict] | None]) -> int:
        """Hold the lock while ``make`` writes data and says which version they
        are part of; returns the version that then is the last."""
        writer = uuid.uuid4().hex
        if not self.running():
            self.fs.delete(self._path(f"{self.root}/lock"), False)
        if not self._put("lock", {"writer": writer, "at": time.time()}):
            raise AlreadyRunning(what)
        try:
            self._say(writer, "started", what)
            made = make(writer)
            last = self._commit(writer, *made) if made else self.version()[0]
            self._say(writer, "done", f"version {last}")
            return last
        except Exception as problem:
            self._say(writer, "failed", f"{type(problem).__name__}: {problem}"[:500])
            raise
        finally:
            lock = self._get("lock")
            if lock is not None and lock["writer"] == writer:
                self.fs.delete(self._path(f"{self.root}/lock"), False)

    def rebuild(self, rows: DataFrame) -> int:
        """A version made of ``rows`` alone."""

        def make(writer: str):
            last, _ = self.version()
            self._say(writer, "writing")
            rows.write.parquet(f"{self.root}/data/{writer}")
            self._say(writer, "written")
            return last + 1, {"folders": [writer], "batches": []}

        return self._write("rebuild", make)

    def patch(self, rows: DataFrame, key: str = "headword", order: str = "ord", batch: str | None = None) -> int:
        """A version with the rows whose key is new behind the old ones, ids
        from the greatest on. ``rows``: key, ``order`` and the other columns but
        ``id``. Only new rows are written; a ``batch`` that is part of the last
        version already is left alone."""

        def make(writer: str):
            last, content = self.version()
            if batch is not None and batch in content["batches"]:
                return None
            old = self.read()
            fresh = first_per_key(rows.where(F.col(key).isNotNull()).join(old.select(key), key, "left_anti"), [key], [order])
            top = old.agg(F.max("id")).first()[0]
            self._say(writer, "writing")
            added = numbered(fresh, [order, key], 0 if top is None else top + 1, "id")
            added.select(*old.columns).write.parquet(f"{self.root}/data/{writer}")
            some = self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{writer}").limit(1).count()
            self._say(writer, "written")
            if not some and batch is None:
                return None
            return last + 1, {"folders": content["folders"] + [writer] * bool(some), "batches": content["batches"] + [batch] * (batch is not None)}

        return self._write("patch", make)

    def follow(self, rows: DataFrame, checkpoint: str, key: str = "headword", order: str = "ord", **trigger) -> StreamingQuery:
        """Patch the table with every micro-batch of a stream."""
        name = checkpoint.rstrip("/").rsplit("/", 1)[-1]
        each = lambda batch, number: self.patch(batch, key, order, f"{name}/{number}")
        return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
