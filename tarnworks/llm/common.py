"""What the operators of this subpackage share: table access, the shared work folder and word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of anything but space, tab, LF, VT, FF and CR. ``bytes.split()`` splits at exactly these.
WHITE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Work:
    """A folder of its own under ``spark.checkpoint.dir``, for tables that cut lineage.

    A table survives lost executors, as it lies in the folder that the cluster names. Where the setting is
    absent, a temporary folder takes its place in local mode, and any other master raises an error: a folder of the
    driver's machine would be no shared one.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="tarnworks-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.tables = spark, 0
        self.root = f"{self.qualified(root).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    @staticmethod
    def _file_system(spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(spark._jsc.hadoopConfiguration())

    def qualified(self, path: str) -> str:
        """A path with its scheme, so that Spark and the tasks' own file access mean the same place."""
        at, fs = self._file_system(self.spark, path)
        return re.sub(r"^file:/+", "file:///", fs.makeQualified(at).toString())

    def path(self, label: str) -> str:
        self.tables += 1
        return f"{self.root}/{self.tables:03d}-{label}"

    def cut(self, df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and return it as read back."""
        path = self.path(label)
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._tarnworks_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            at, fs = self._file_system(self.spark, table._tarnworks_path)
            fs.delete(at, True)


def words(text: Column) -> Column:
    """Words of a text as a native array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without building them twice: the pieces between white space, less the empty ones at the ends."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(text, WHITE))
    ends = F.when(text.rlike(rf"^{WHITE}"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]$|^$"), 1).otherwise(0)
    return F.greatest(F.lit(0), pieces - ends).cast("long")


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once."""
    return F.transform(F.array(value), function)[0]


def over_batches(rows: DataFrame, function: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """What ``function`` makes of the Arrow batches of ``rows``, each as lists by column.

    Values stay what they are, beside nulls too: pandas would turn integers with a null among them into floats.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        lists = (dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns))) for batch in batches if batch.num_rows)
        for out in function(lists):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return rows.mapInArrow(run, schema)


def filtered(rows: DataFrame, keeps: Callable[[list], list[bool]], column: str) -> DataFrame:
    """Rows whose ``column`` values ``keeps`` marks, a batch at a time; all other columns pass as they are."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keeps(batch.column(batch.schema.names.index(column)).to_pylist()), pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
