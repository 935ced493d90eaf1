"""Session settings that long jobs need."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def own_folder(master: str) -> str:
    """A temporary folder of this machine, which serves only where tasks run in the driver's process."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return tempfile.mkdtemp(prefix="tarnworks-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's address below the one that the session names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark.sparkContext.master)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return re.sub(r"^file:/+", "file:///", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString())


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, from the folder that the session names in spark.checkpoint.dir.

    Loops that use a step's result more than once need it, or their plans double with every round. Where the
    setting is absent, a temporary folder takes its place in local mode, and any other master raises an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own_folder(context.master))
    return df.checkpoint()


def cut_afresh(df: DataFrame) -> DataFrame:
    """``cut`` without size estimates, which a checkpoint keeps and joins multiply: in long loops their digits double each round."""
    held, spark = cut(df), df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(held._jdf.rdd(), held._jdf.schema()), spark)


def builder(app: str = "tarnworks") -> SparkSession.Builder:
    """A session with UTC times and adaptive execution, skewed joins included."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
