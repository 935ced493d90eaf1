"""Two versions of a table: what changed, what wins, what drifted."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, key: str, *values: str) -> DataFrame:
    """key, change: added, deleted, modified or same."""
    a, b = before.select(key, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(1).alias("in_a")), after.select(key, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(1).alias("in_b"))
    same = reduce(Column.__and__, [F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")) for v in values])
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "deleted").when(same, "same").otherwise("modified").alias("change"))


def changed_fields(before: DataFrame, after: DataFrame, key: str, *values: str) -> DataFrame:
    """key and the sorted names of fields that differ, for rows on both sides."""
    both = before.select(key, *(F.col(v).alias(f"a_{v}") for v in values)).join(after.select(key, *(F.col(v).alias(f"b_{v}") for v in values)), key)
    names = F.array_sort(F.array_compact(F.array(*(F.when(~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")), F.lit(v)) for v in values))))
    return both.select(key, names.alias("fields")).where(F.size("fields") > 0)


def last_writer_wins(local: DataFrame, remote: DataFrame, key: str, stamp: str, *values: str) -> DataFrame:
    """One row a key: that of the later stamp, the local one on a tie; a missing value comes from the other side."""
    a = local.select(key, *(F.col(v).alias(f"a_{v}") for v in (*values, stamp)))
    b = remote.select(key, *(F.col(v).alias(f"b_{v}") for v in (*values, stamp)))
    a_wins = F.col(f"b_{stamp}").isNull() | (F.col(f"a_{stamp}") >= F.col(f"b_{stamp}"))
    pick = lambda v: F.when(a_wins, F.coalesce(f"a_{v}", f"b_{v}")).otherwise(F.coalesce(f"b_{v}", f"a_{v}"))
    origin = F.when(F.col(f"a_{stamp}").isNull(), "remote").when(F.col(f"b_{stamp}").isNull(), "local").when(F.col(f"a_{stamp}") == F.col(f"b_{stamp}"), "both").when(a_wins, "local_newer").otherwise("remote_newer")
    return a.join(b, key, "full_outer").select(key, *(pick(v).alias(v) for v in (*values, stamp)), origin.alias("origin"))


def deltas(before: DataFrame, after: DataFrame, key: str, *values: str) -> DataFrame:
    """Every key of either side with the change of each value; a missing side counts 0."""
    a, b = before.select(key, *(F.col(v).alias(f"a_{v}") for v in values)), after.select(key, *(F.col(v).alias(f"b_{v}") for v in values))
    both = a.join(b, key, "full_outer")
    return both.select(key, *((F.coalesce(f"b_{v}", F.lit(0)) - F.coalesce(f"a_{v}", F.lit(0))).alias(f"delta_{v}") for v in values))


def stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per zone of both sides: files kept over files of either."""
    size = lambda t, n: t.groupBy("zone").agg(F.count("*").alias(n))
    kept = before.join(after, ["zone", "path"]).groupBy("zone").agg(F.count("*").alias("kept"))
    rows = size(before, "n_before").join(size(after, "n_after"), "zone").join(kept, "zone", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return rows.withColumn("stability", F.col("kept") / (F.col("n_before") + F.col("n_after") - F.col("kept")))


def newest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the order given (dedupe by source, last version, and the like)."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def applied_deltas(totals: DataFrame, removed: DataFrame, added: DataFrame, key: str, *values: str) -> DataFrame:
    """Running totals after rows were removed and added; a key whose ``runs`` fall to 0 goes."""
    names = (*values, "runs")
    signed = removed.groupBy(key).agg(*(-F.sum(v).alias(v) for v in values), (-F.count("*")).alias("runs")).toDF(key, *names).unionByName(added.groupBy(key).agg(*(F.sum(v).alias(v) for v in values), F.count("*").alias("runs")))
    return totals.select(key, *names).unionByName(signed).groupBy(key).agg(*(F.sum(v).alias(v) for v in names)).where("runs > 0")


def refreshed_edges(edges: DataFrame, changed: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Edges of unchanged files and the new ones of changed files."""
    return edges.join(changed.select(F.col("path").alias("from")), "from", "left_anti").select(recomputed.columns).unionByName(recomputed)


def fingerprint(listing: DataFrame, *columns: str) -> str:
    """A digest of a listing's rows, whatever their order; two sums of hashes, made where the rows are."""
    parts = [F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)")) for salt in (1, 2)]
    return "-".join(str(x) for x in listing.agg(F.count("*"), *parts).first())


def remembered(folder: str, name: str, print_: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build`` as it was kept for this fingerprint of its inputs, or built and kept now.

    A result is a Parquet table named by both; one that another job is still writing isn't complete and is built anew.
    """
    path = f"{folder}/{name}-{print_}"
    spark = SparkSession.getActiveSession()
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Orders in which tables are written, so that equal ones give equal files.
CANONICAL = {
    "files": ("path",),
    "edges": ("from", "to", "type"),
    "crossings": ("from_zone", "to_zone", "from", "to"),
    "zones": ("zone",),
    "externals": ("package",),
    "calls": ("caller_file", "caller", "callee_file", "callee"),
    "functions": ("file", "line", "name"),
}


def canonical(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of a kind of table in its canonical order, by bytes, as far as they have its columns."""
    return rows.orderBy(*(c for c in CANONICAL[kind] if c in rows.columns))
