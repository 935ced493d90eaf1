"""A keyed table whose versions are commits in a log: snapshots, upserts and deletions, transactions that retry.

Rows lie in Parquet files by bucket of their key. A commit writes the buckets that it touches anew and then claims the
next version's log entry, a file that only one writer can create. A writer that finds the version taken looks at what
came between: if others touched none of its buckets, it claims the following version with the files it has; else it
starts again from the new snapshot. Nothing is locked, readers never wait, and a writer that dies leaves files that no
entry names. An entry holds where each changed bucket now lies, every ``WHOLE``-th the place of all.

The log is read and written by the driver and grows with commits, not with rows. Log entries are created with a hard
link on a local file system and with a rename that doesn't replace on others (HDFS); object stores without either
aren't supported.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELETED = "_deleted"
WHOLE = 20


class Conflict(Exception):
    """Other writers were first, more often than the writer was willing to start again."""


class Store:
    """Rows with one string or integer ``key``; ``buckets`` is what a commit writes anew at least, and is fixed when the store is made."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 16):
        self.spark, self.key = spark, key
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self._fs.makeQualified(self._paths(path)).toString().rstrip("/")
        self.retried = 0
        if self.version() is None:
            self._claim(0, {"key": key, "buckets": buckets, "schema": None, "places": {}, "whole": True})
        first = self._entry(0)
        if first["key"] != key:
            raise ValueError(f"the store's key is {first['key']}")
        self.buckets = first["buckets"]

    # -- log

    def _at(self, version: int) -> str:
        return f"{self.path}/log/{version:012d}.json"

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._paths(self._at(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def version(self) -> int | None:
        """The last version, or None before the first."""
        folder = self._paths(f"{self.path}/log")
        if not self._fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=None)

    def _claim(self, version: int, entry: dict) -> bool:
        """Create the version's entry, whole, unless there is one."""
        to, draft = self._paths(self._at(version)), self._paths(f"{self.path}/log/.{uuid.uuid4().hex}")
        sink = self._fs.create(draft, False)
        sink.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        sink.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(unquote(urlparse(draft.toString()).path), unquote(urlparse(to.toString()).path))
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(draft, to, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Exception:
            if self._fs.exists(to):
                return False
            raise
        finally:
            if self._fs.exists(draft):
                self._fs.delete(draft, False)

    def state(self, version: int) -> tuple[str | None, dict[str, str]]:
        """Schema and the folder of each bucket that has rows, as of a version."""
        entries, at = [], version
        while True:
            entries.append(self._entry(at))
            if entries[-1].get("whole"):
                break
            at -= 1
        schema, places = None, {}
        for entry in reversed(entries):
            schema = entry["schema"] or schema
            places |= entry["places"]
        return schema, {b: p for b, p in places.items() if p}

    # -- reading

    def snapshot(self, version: int | None = None) -> DataFrame | None:
        """All rows as of a version (the last); None before the first rows."""
        return self._rows(*self.state(self.version() if version is None else version))

    def _rows(self, schema: str | None, places: dict[str, str], buckets: set[int] | None = None) -> DataFrame | None:
        if schema is None:
            return None
        folders = [f"{self.path}/data/{p}/_bucket={b}" for b, p in places.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        """version, note and buckets touched of every commit."""
        rows = [(v, e.get("note", ""), len(e["places"]) if not e.get("whole") else len(e.get("touched", []))) for v, e in ((v, self._entry(v)) for v in range(self.version() + 1))]
        return self.spark.createDataFrame(rows, "version int, note string, touched int")

    # -- writing

    def merge(self, changes: DataFrame, note: str = "", retries: int = 10) -> int:
        """Insert or replace rows by key, or delete those with a true ``_deleted``; returns the version.

        Keys that occur twice in ``changes`` are an error, as neither is the last. A null key is one too.
        """
        return self._commit(lambda _: changes, note, retries, whole=False)

    def transact(self, change: Callable[[DataFrame | None], DataFrame], note: str = "", retries: int = 10) -> int:
        """Merge what ``change`` makes of the last snapshot; it is called again if another commit came between."""
        return self._commit(change, note, retries, whole=True)

    def _commit(self, change, note, retries, whole: bool) -> int:
        for _ in range(retries + 1):
            seen = self.version()
            schema, places = self.state(seen)
            entry = self._written(change(self._rows(schema, places)), schema, places) | {"note": note}
            while True:
                last = self.version()
                between = [self._entry(v) for v in range(seen + 1, last + 1)]
                touched = {b for e in between for b in e.get("touched", e["places"])}
                if between and (whole or touched & set(entry["touched"]) or any(e["schema"] not in (None, schema) for e in between)):
                    break
                own = dict(entry)
                if (last + 1) % WHOLE == 0:
                    own |= {"whole": True, "schema": entry["schema"] or self.state(last)[0], "places": self.state(last)[1] | entry["places"]}
                if self._claim(last + 1, own):
                    return last + 1
            self.retried += 1
        raise Conflict(f"{retries + 1} attempts at {self.path}")

    def _written(self, changes: DataFrame, schema: str | None, places: dict[str, str]) -> dict:
        """Write the touched buckets anew; the log entry that names them."""
        key, folder = F.col(self.key), uuid.uuid4().hex
        if DELETED not in changes.columns:
            changes = changes.withColumn(DELETED, F.lit(False))
        bucket = F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")
        changes = changes.withColumn("_bucket", bucket).persist()
        try:
            counts = changes.groupBy("_bucket").agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).collect()  # a row a bucket
            if any(r.n != r.d for r in counts):
                raise ValueError("null or repeated keys among the changes")
            touched = {r["_bucket"] for r in counts}
            new = changes.where(~F.coalesce(DELETED, F.lit(False))).drop(DELETED)
            old = self._rows(schema, places, touched)
            if old is not None:
                kept = old.join(changes.select(self.key), self.key, "left_anti").withColumn("_bucket", bucket)
                new = new.unionByName(kept, allowMissingColumns=True)
            fields = new.drop("_bucket").schema
            new.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        finally:
            changes.unpersist()
        there = {str(b): folder if self._fs.exists(self._paths(f"{self.path}/data/{folder}/_bucket={b}")) else None for b in touched}
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        return {"schema": None if ddl == schema else ddl, "places": there, "touched": sorted(there)}

    def vacuum(self, keep: int = 10) -> int:
        """Delete data folders that none of the last ``keep`` versions names, staged ones of running writers too; how many."""
        last = self.version()
        used = {p for v in range(max(0, last - keep + 1), last + 1) for p in self.state(v)[1].values()}
        data = self._paths(f"{self.path}/data")
        gone = [s.getPath() for s in self._fs.listStatus(data) if s.getPath().getName() not in used] if self._fs.exists(data) else []
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)
