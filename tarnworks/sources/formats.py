"""Folders of small files as Spark data sources, and a registry of such sources.

``spark.read.format("tarnworks_records")`` reads one JSON object a file (run records, items), plain or gzipped;
``"tarnworks_inventory"`` lists files with digest, lines and language. Both plan partitions of about ``bytesPerPartition``
from a listing, leave out what a pushed filter on names or sizes excludes before any file is opened, and serve batches
and streams. Records are also written: a task stages its files under the write's own folder, the commit moves them in
place, and an abort deletes them, so a failed or repeated task leaves nothing behind.

Files are opened with pyarrow; a path needs a scheme that it knows (none and file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import fnmatch
import gzip
import hashlib
import json
import math
import time
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructType

from tarnworks.sources.readers import LANGUAGES

STAGING = ".staging-"
PARTITION = 16 << 20
#: What opening a file costs, in bytes.
OPEN_COST = 64 << 10
#: A stream's listing serves so many times as long as it took, so listings take a tenth of the time at most.
RELISTED = 10


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    fs, base = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
    return fs, base.rstrip("/")


@dataclass(frozen=True)
class File:
    path: str  # below the folder
    size: int
    modified: int  # nanoseconds


@dataclass
class Files(InputPartition):
    files: list[File] = field(default_factory=list)


def listed(path: str, pattern: str = "*") -> list[File]:
    """Files below a folder whose names match, without those in hidden or staged folders, in order of time and path."""
    fs, base = opened(path)
    found = []
    for info in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
        below = info.path[len(base) + 1 :]
        if info.type == pafs.FileType.File and not any(p.startswith(".") for p in below.split("/")) and fnmatch.fnmatch(info.base_name, pattern):
            found.append(File(below, info.size, info.mtime_ns or 0))
    return sorted(found, key=lambda f: (f.modified, f.path))


def packed(files: list[File], most: int) -> list[Files]:
    """Partitions of about ``most`` bytes each."""
    out, size = [], most
    for f in files:
        if size >= most:
            out.append(Files())
            size = 0
        out[-1].files.append(f)
        size += f.size + OPEN_COST
    return out


#: How a pushed filter compares.
COMPARISONS = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b,
    StringStartsWith: lambda a, b: a.startswith(b),
}


def holds(test: Filter, value) -> bool:
    return value is not None and COMPARISONS[type(test)](value, test.value)


class FolderReader(DataSourceReader):
    """Plans and reads files; ``known`` gives the columns that a listing alone tells, which filters can prune by."""

    def __init__(self, options, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.pattern = options.get("pattern", "*")
        self.most = int(options.get("bytesPerPartition", PARTITION))
        self.tests: list[Filter] = []

    known: dict = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if type(test) in COMPARISONS and test.attribute[0] in self.known and len(test.attribute) == 1:
                self.tests.append(test)
            else:
                yield test

    def wanted(self, file: File) -> bool:
        return all(holds(t, self.known[t.attribute[0]](file)) for t in self.tests)

    def chosen(self, files: list[File]) -> list[File]:
        return [f for f in files if self.wanted(f)]

    def partitions(self) -> list[Files]:
        return packed(self.chosen(listed(self.path, self.pattern)), self.most) or [Files()]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, base = opened(self.path)
        for file in partition.files:
            with fs.open_input_stream(f"{base}/{file.path}", compression=None) as source:
                data = source.read()
            row = self.row(file, data)
            if row is not None:
                yield row

    def row(self, file: File, data: bytes) -> tuple | None:
        raise NotImplementedError


class FolderStream(DataSourceStreamReader):
    """New files of a folder, in order of time and path; an offset is the last file taken.

    Files must reach the folder by a rename or with their final time, as a file older than the last taken is not seen.
    A listing serves many batches: it is made anew once all of it is taken, or ``RELISTED`` times as long after it as it took.
    """

    def __init__(self, reader: FolderReader, most_files: int):
        self.reader, self.most_files = reader, most_files
        self.last = self.initialOffset()
        self.seen: list[File] = []  # the latest listing
        self.due = 0.0  # when it is too old

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def list(self) -> None:
        began = time.monotonic()
        self.seen = listed(self.reader.path, self.reader.pattern)
        self.due = time.monotonic() + RELISTED * (time.monotonic() - began)

    def after(self, offset: dict) -> int:
        """Where in the listing the files after an offset begin."""
        return bisect_right(self.seen, (offset["modified"], offset["path"]), key=lambda f: (f.modified, f.path))

    def latestOffset(self) -> dict:
        if time.monotonic() >= self.due or self.after(self.last) == len(self.seen):
            self.list()
        at = self.after(self.last)
        new = self.seen[at : at + self.most_files]
        if new:
            self.last = {"modified": new[-1].modified, "path": new[-1].path}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.last = max(self.last, end, key=lambda o: (o["modified"], o["path"]))
        to = self.after(end)
        if not to or (self.seen[to - 1].modified, self.seen[to - 1].path) != (end["modified"], end["path"]):  # a batch of an earlier run
            self.list()
        new = self.seen[self.after(start) : self.after(end)]
        return packed(self.reader.chosen(new), self.reader.most) or [Files()]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.reader.read(partition)


def language(file: File) -> str:
    _, dot, extension = file.path.rpartition("/")[2].rpartition(".")
    return LANGUAGES.get(extension.lower(), "Other") if dot else "Other"


def stem(file: File) -> str:
    return file.path.rpartition("/")[2].removesuffix(".gz").removesuffix(".json")


def converted(value, kind):
    """A JSON value as the type of a column; one that doesn't fit is null."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(converted(value.get(f.name), f.dataType) for f in kind) if isinstance(value, dict) else None
    if isinstance(kind, ArrayType):
        return [converted(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, MapType):
        return {k: converted(v, kind.valueType) for k, v in value.items()} if isinstance(value, dict) else None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if isinstance(kind, (IntegerType, LongType)):
        if isinstance(value, float) and not math.isfinite(value):
            return None
        bits = 31 if isinstance(kind, IntegerType) else 63
        return int(value) if value == int(value) and -(1 << bits) <= value < 1 << bits else None
    return float(value) if isinstance(kind, DoubleType) else None


class RecordReader(FolderReader):
    """One JSON object a file; its id is the file's name. Broken files give no row, a plain file hides its gzipped copy."""

    known = {"id": stem, "modified_ms": lambda f: f.modified // 1_000_000, "bytes": lambda f: f.size}

    def chosen(self, files):
        plain = {f.path for f in files}
        return [f for f in super().chosen(files) if not (f.path.endswith(".gz") and f.path.removesuffix(".gz") in plain)]

    def row(self, file, data):
        try:
            record = json.loads(gzip.decompress(data) if file.path.endswith(".gz") else data)
        except (ValueError, OSError, EOFError):
            return None
        if not isinstance(record, dict):
            return None
        return tuple(self.known[f.name](file) if f.name in self.known else converted(record.get(f.name), f.dataType) for f in self.schema)


class InventoryReader(FolderReader):
    """Size, time, digest, lines and language of each file; lines are 0 where a null byte is among the first 8,192."""

    known = {"path": lambda f: f.path, "size": lambda f: f.size, "language": language}

    def row(self, file, data):
        lines = 0 if not data or b"\0" in data[:8192] else data.count(b"\n") + (not data.endswith(b"\n"))
        when = datetime.fromtimestamp(file.modified / 1e9, timezone.utc).replace(tzinfo=None)
        return file.path, file.size, when, hashlib.sha256(data).hexdigest(), lines, self.known["language"](file)


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]


class RecordWriter(DataSourceWriter):
    """Writes each row as ``<id>.json``, keys in order, nulls left out; ``overwrite`` leaves no other record."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.zipped = options.get("compression", "none") == "gzip"
        self.staging = f"{STAGING}{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Staged:
        fs, base = opened(self.path)
        own, names = f"{base}/{self.staging}/{uuid.uuid4().hex}", []
        fs.create_dir(own, recursive=True)
        for row in rows:
            record = {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
            name = record.get("id")
            if not name or name.startswith(".") or "/" in name:
                raise ValueError(f"not a file name: {name!r}")
            data = json.dumps(record, sort_keys=True, ensure_ascii=False, default=str).encode()
            name += ".json.gz" if self.zipped else ".json"
            with fs.open_output_stream(f"{own}/{name}", compression=None) as sink:
                sink.write(gzip.compress(data, mtime=0) if self.zipped else data)
            names.append(f"{own[len(base) + 1 :]}/{name}")
        return Staged(names)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, base = opened(self.path)
        kept = set()
        for message in messages:
            for staged in message.names if message else ():
                name = staged.rpartition("/")[2]
                fs.move(f"{base}/{staged}", f"{base}/{name}")
                kept.add(name)
        if self.overwrite:
            for file in listed(self.path):
                if file.path not in kept:
                    fs.delete_file(f"{base}/{file.path}")
        self.cleared(fs, base)

    def abort(self, messages: list[Staged | None]) -> None:
        self.cleared(*opened(self.path))

    def cleared(self, fs: pafs.FileSystem, base: str) -> None:
        if fs.get_file_info(f"{base}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/{self.staging}")


class FolderSource(DataSource):
    """What the sources of this module share; ``needs`` are options that must be given, ``secret`` ones are never shown."""

    needs: tuple[str, ...] = ("path",)
    secret: tuple[str, ...] = ()
    about = ""
    reads: type[FolderReader]

    def __init__(self, options):
        super().__init__(options)
        missing = [n for n in self.needs if not options.get(n)]
        if missing:
            raise ValueError(f"source {self.name()} needs {', '.join(missing)}")

    def reader(self, schema: StructType) -> FolderReader:
        return self.reads(self.options, schema)

    def streamReader(self, schema: StructType) -> FolderStream:
        return FolderStream(self.reader(schema), int(self.options.get("maxFilesPerTrigger", 1000)))


class Records(FolderSource):
    about, reads = "one JSON object a file", RecordReader

    @classmethod
    def name(cls) -> str:
        return "tarnworks_records"

    def schema(self) -> str:
        return "id string, status string, startedAt string, finishedAt string, model string, vendor string, modified_ms long, bytes long"

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, overwrite)


class Inventory(FolderSource):
    about, reads = "files with digest, lines and language", InventoryReader

    @classmethod
    def name(cls) -> str:
        return "tarnworks_inventory"

    def schema(self) -> str:
        return "path string, size long, modified timestamp, hash string, lines long, language string"


BUILT_IN = (Records, Inventory)
#: Option names that are secret whatever a source says.
SECRET = ("token", "secret", "apikey", "api_key", "password")


class Registry:
    """Sources by name for one session; built-in ones can't be replaced or taken out."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        for source in BUILT_IN:
            self.add(source)

    def add(self, source: type[DataSource]) -> None:
        name = source.name()
        if not name.strip():
            raise ValueError("a source needs a name")
        if name in self.held:
            raise ValueError(f"source {name} is already registered")
        self.spark.dataSource.register(source)
        self.held[name] = source

    def remove(self, name: str) -> None:
        """Take a source out of the registry; Spark itself keeps its class until another takes its name."""
        if name in {s.name() for s in BUILT_IN}:
            raise ValueError(f"source {name} is built in")
        if name not in self.held:
            raise ValueError(f"source {name} is not registered")
        del self.held[name]

    def options(self, name: str, config: dict) -> dict[str, str]:
        """Options of a source as Spark takes them, once all that it needs are there."""
        if name not in self.held:
            raise ValueError(f"source {name} is not registered")
        missing = [n for n in getattr(self.held[name], "needs", ()) if config.get(n) in (None, "")]
        if missing:
            raise ValueError(f"source {name} needs {', '.join(missing)}")
        return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in config.items()}

    def read(self, name: str, schema: str | None = None, **config):
        reader = self.spark.read.format(name).options(**self.options(name, config))
        return (reader.schema(schema) if schema else reader).load()

    def read_stream(self, name: str, schema: str | None = None, **config):
        reader = self.spark.readStream.format(name).options(**self.options(name, config))
        return (reader.schema(schema) if schema else reader).load()

    def shown(self, name: str, config: dict) -> dict[str, str]:
        """Options fit to be shown: of a secret its first and last four characters, or none if it is short."""
        hidden = {*SECRET, *getattr(self.held.get(name), "secret", ())}
        return {k: (f"{v[:4]}****{v[-4:]}" if len(v) > 8 else "****") if k in hidden or k.lower() in SECRET else v for k, v in ((k, str(v)) for k, v in config.items())}

    def table(self):
        """name, about, built_in and needs of every source."""
        rows = [(n, getattr(s, "about", ""), s in BUILT_IN, list(getattr(s, "needs", ()))) for n, s in sorted(self.held.items())]
        return self.spark.createDataFrame(rows, "name string, about string, built_in boolean, needs array<string>")
