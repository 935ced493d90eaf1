"""Driver tables in the shapes that operators take, and the same shapes as SQL views for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"
TREE_NOW = "2001-09-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its times as instants in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage: cents of the value are input tokens, ``k`` of the props output tokens."""
    e = table(spark, sf_dir, "events")
    n = F.col("user_id") % 3
    return e.select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_text"),
        F.col("event_type").alias("command"),
        F.when(n == 0, "log").when(n == 1, "runs").otherwise("manifest").alias("package"),
        F.when(F.col("user_id") % 2 == 0, "alpha").otherwise("beta").alias("vendor"),
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("input"),
        F.get_json_object("props", "$.k").cast("long").alias("output"),
        F.lit(1).cast("long").alias("calls"),
    )


TOKEN_EVENTS = """token_events AS (SELECT event_id, user_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_text, event_type AS command,
 CASE user_id % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'runs' ELSE 'manifest' END AS package, CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS vendor,
 'm' || (user_id % 4) AS model, CAST(floor(value * 100 + 0.5) AS BIGINT) AS input, CAST(json_extract(props, '$.k') AS BIGINT) AS output, CAST(1 AS BIGINT) AS calls FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of a task each: errors failed, views hit a limit, the rest completed."""
    e = token_events(spark, sf_dir)
    status = F.when(F.col("command") == "error", "failed").when(F.col("command") == "view", "limit").otherwise("completed")
    return e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("task"), "ts", status.alias("status"), F.col("input").alias("tokens"), F.col("output").alias("turns"))


RUNS = TOKEN_EVENTS + """, runs AS (SELECT event_id AS run_id, user_id AS task, ts, CASE command WHEN 'error' THEN 'failed' WHEN 'view' THEN 'limit' ELSE 'completed' END AS status,
 input AS tokens, output AS turns FROM token_events)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer and order as epic, feature, task and subtask."""
    t = lambda n: table(spark, sf_dir, n)
    null = lambda kind: F.lit(None).cast(kind)
    parts = [
        t("region").select(F.concat(F.lit("R:"), F.col("r_regionkey")).alias("id"), null("string").alias("parent_id"), F.lit("epic").alias("level"), F.lit("pending").alias("status"), null("string").alias("priority"), F.col("r_name").alias("title"), null("timestamp").alias("started_at")),
        t("nation").select(F.concat(F.lit("N:"), F.col("n_nationkey")), F.concat(F.lit("R:"), F.col("n_regionkey")), F.lit("feature"), F.lit("pending"), null("string"), "n_name", null("timestamp")),
        t("customer").select(F.concat(F.lit("C:"), F.col("c_custkey")), F.concat(F.lit("N:"), F.col("c_nationkey")), F.lit("task"), F.when(F.col("c_custkey") % 5 == 0, "completed").when(F.col("c_custkey") % 7 == 0, "blocked").otherwise("pending"), F.when(F.col("c_mktsegment") == "BUILDING", "high").when(F.col("c_mktsegment") == "MACHINERY", "low"), "c_name", null("timestamp")),
        t("orders").select(
            F.concat(F.lit("O:"), F.col("o_orderkey")),
            F.concat(F.lit("C:"), F.col("o_custkey")),
            F.lit("subtask"),
            F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("pending"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").when(F.col("o_orderpriority") == "5-LOW", "low"),
            F.concat(F.lit("order "), F.col("o_orderkey")),
            F.col("o_orderdate").cast("timestamp"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


ITEMS = """items AS (
 SELECT 'R:' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, 'epic' AS level, 'pending' AS status, CAST(NULL AS VARCHAR) AS priority, r_name AS title, CAST(NULL AS TIMESTAMP) AS started_at FROM region
 UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'feature', 'pending', NULL, n_name, NULL FROM nation
 UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'task', CASE WHEN c_custkey % 5 = 0 THEN 'completed' WHEN c_custkey % 7 = 0 THEN 'blocked' ELSE 'pending' END,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'high' WHEN 'MACHINERY' THEN 'low' END, c_name, NULL FROM customer
 UNION ALL SELECT 'O:' || o_orderkey, 'C:' || o_custkey, 'subtask', CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'in_progress' ELSE 'pending' END,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END, 'order ' || o_orderkey, o_orderdate FROM orders)"""
CLOSURE = ITEMS + """, closure AS (
 SELECT id AS ancestor, id, 0 AS distance FROM items
 UNION ALL SELECT p.id, i.id, 1 FROM items i JOIN items p ON i.parent_id = p.id
 UNION ALL SELECT g.id, i.id, 2 FROM items i JOIN items p ON i.parent_id = p.id JOIN items g ON p.parent_id = g.id
 UNION ALL SELECT h.id, i.id, 3 FROM items i JOIN items p ON i.parent_id = p.id JOIN items g ON p.parent_id = g.id JOIN items h ON g.parent_id = h.id)"""
TREE_LEVELS = 4


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as an edge from its supplier's nation to its customer's nation."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.concat(F.lit("N"), F.col("s_nationkey")).alias("from"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("to"))


TRADE = """trade AS (SELECT 'N' || s_nationkey AS src, 'N' || c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def heavy_trade(spark: SparkSession, sf_dir: str, times: float = 1.0) -> DataFrame:
    """Pairs of nations with more edges than so many times the mean pair; without loops."""
    pairs = trade(spark, sf_dir).groupBy("from", "to").agg(F.count("*").alias("n")).where("from != to")
    return pairs.crossJoin(pairs.agg(F.avg("n").alias("mean"))).where(F.col("n") > F.col("mean") * times).select("from", "to")  # one mean


HEAVY = TRADE + """, pairs AS (SELECT src, dst, count(*) AS n FROM trade WHERE src <> dst GROUP BY 1, 2), heavy AS (SELECT src, dst FROM pairs WHERE n > (SELECT avg(n) FROM pairs) * 1.1)"""
OVER_MEAN = TRADE + """, pairs AS (SELECT src, dst, count(*) AS n FROM trade WHERE src <> dst GROUP BY 1, 2), heavy AS (SELECT src, dst FROM pairs WHERE n > (SELECT avg(n) FROM pairs))"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("path"), F.concat(F.lit("Z"), F.col("n_regionkey")).alias("zone"))


ZONES = """zones AS (SELECT 'N' || n_nationkey AS path, 'Z' || n_regionkey AS zone FROM nation)"""


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as an edge from its part to its supplier."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey")).alias("from"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("to"))


SUPPLY = """supply AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM lineitem)"""
