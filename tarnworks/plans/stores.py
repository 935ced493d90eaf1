"""Queries over registered sources, the versioned store and table functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnworks.operators.cycles import Components, numbered
from tarnworks.plans.tables import table
from tarnworks.session import scratch
from tarnworks.sources import writers
from tarnworks.sources.formats import Registry
from tarnworks.sources.store import DELETED, Store
from tarnworks.streaming import ordered, streams

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RECORD = "id string, status string, startedAt string, tokenUsage struct<input:bigint,output:bigint>, tools array<string>, counts map<string,bigint>"


def user_records(spark, sf_dir):
    """A record for each user: its events as a run's usage."""
    n = F.floor("value").cast("long")
    usage = F.struct(F.sum(n).alias("input"), F.count("*").alias("output"))
    status = F.when(F.col("user_id") % 3 == 0, "failed").otherwise("completed")
    tools = F.array_sort(F.collect_set("event_type"))
    clicks = F.create_map(F.lit("clicks"), F.count_if(F.col("event_type") == "click"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(usage.alias("tokenUsage"), tools.alias("tools"), clicks.alias("counts"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("startedAt"))
    return rows.select(F.concat(F.lit("r"), "user_id").alias("id"), status.alias("status"), "startedAt", "tokenUsage", "tools", "counts")


def record_folder(spark, sf_dir):
    """Records of all users, in two appends, one of them gzipped; every one of the second half of users is written twice."""
    Registry(spark)
    folder, rows = scratch(spark, "records"), user_records(spark, sf_dir)
    rows.write.format("tarnworks_records").mode("append").option("compression", "gzip").save(folder)
    rows.where(F.crc32(F.col("id").cast("binary")) % 2 == 0).write.format("tarnworks_records").mode("append").save(folder)
    return folder


USERS = """users AS (SELECT 'r' || user_id AS id, CASE WHEN user_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started,
 CAST(sum(floor(value)) AS BIGINT) AS input, count(*) AS output, count(*) FILTER (event_type = 'click') AS clicks, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tools FROM events GROUP BY user_id)"""


@query(f"WITH {USERS} SELECT * FROM users")
def formatted_records(spark, sf_dir):
    """Records written and read through the registered source; plain files hide their gzipped copies."""
    rows = Registry(spark).read("tarnworks_records", RECORD, path=record_folder(spark, sf_dir), bytesPerPartition=1 << 20)
    return rows.select("id", "status", F.col("startedAt").alias("started"), "tokenUsage.input", "tokenUsage.output", F.col("counts")["clicks"].alias("clicks"), F.array_join("tools", ",").alias("tools"))


@query(f"WITH {USERS} SELECT status, count(*) AS records, CAST(sum(input) AS BIGINT) AS input FROM users WHERE id LIKE 'r1%' AND id >= 'r10' GROUP BY status")
def formatted_records_by_name(spark, sf_dir):
    """Only files whose names pass the pushed filters are opened."""
    rows = Registry(spark).read("tarnworks_records", RECORD, path=record_folder(spark, sf_dir))
    return rows.where(F.startswith("id", F.lit("r1")) & (F.col("id") >= "r10")).groupBy("status").agg(F.count("*").alias("records"), F.sum("tokenUsage.input").alias("input"))


@query(f"WITH {USERS} SELECT status, count(*) AS records, CAST(sum(output) AS BIGINT) AS output FROM users GROUP BY status")
def streamed_records(spark, sf_dir):
    """Records as a stream of files, some in each micro-batch, summed as they come."""
    Registry(spark)
    folder = scratch(spark, "records")
    user_records(spark, sf_dir).repartition(8).write.format("tarnworks_records").mode("append").save(folder)
    rows = Registry(spark).read_stream("tarnworks_records", RECORD, path=folder, maxFilesPerTrigger=400)
    return streams.drained(rows.groupBy("status").agg(F.count("*").alias("records"), F.sum("tokenUsage.output").alias("output")), scratch(spark, "counted"), "complete", by_turns=True, parts=2)


FILES = "SELECT CASE s_nationkey % 3 WHEN 0 THEN 'src/n' WHEN 1 THEN 'docs/n' ELSE 'data/n' END || s_nationkey || '/s' || s_suppkey || CASE s_nationkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.md' ELSE '.bin' END AS path, s_suppkey AS k, s_name || chr(10) || s_suppkey AS text FROM supplier"


@query(f"WITH f AS ({FILES}) SELECT path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash, 2 AS lines, CASE right(path, 3) WHEN '.ts' THEN 'TypeScript' WHEN '.md' THEN 'Markdown' ELSE 'Other' END AS language FROM f WHERE path LIKE 'src/%' OR path LIKE 'docs/%'")
def formatted_inventory(spark, sf_dir):
    """A file for each supplier, listed by the registered source under two pushed prefixes."""
    k = F.col("s_nationkey") % 3
    pick = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).otherwise(c)
    path = F.concat(pick("src/n", "docs/n", "data/n"), "s_nationkey", F.lit("/s"), "s_suppkey", pick(".ts", ".md", ".bin"))
    folder, source = scratch(spark, "files"), Registry(spark)
    writers.text_files(table(spark, sf_dir, "supplier").select(path.alias("path"), F.concat("s_name", F.lit("\n"), "s_suppkey").alias("text")), folder)
    parts = [source.read("tarnworks_inventory", path=folder).where(F.startswith("path", F.lit(top))) for top in ("src/", "docs/")]
    return parts[0].unionByName(parts[1]).select("path", "size", "hash", F.col("lines").cast("int").alias("lines"), "language")


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'closed' ELSE o_orderstatus END AS status, CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS edits FROM orders WHERE NOT (o_custkey % 7 = 0 AND o_custkey % 5 <> 0)
UNION ALL SELECT -n_nationkey - 1, 'new', 0 FROM nation""")
def stored_orders(spark, sf_dir):
    """Orders in a store: loaded, some updated, some deleted (but for updated ones), new ones put in."""
    store, key = Store(spark, scratch(spark, "store")), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(0).alias("edits"), key)
    store.merge(rows, "load")
    store.transact(lambda now: now.where(key % 5 == 0).withColumns({"status": F.lit("closed"), "edits": F.col("edits") + 1}), "close")
    store.transact(lambda now: now.where((key % 7 == 0) & (F.col("edits") == 0)).withColumn(DELETED, F.lit(True)), "delete")
    store.merge(table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("id"), F.lit("new").alias("status"), F.lit(0).alias("edits"), F.lit(0).cast("long").alias("o_custkey")), "new")
    return store.snapshot().select("id", "status", "edits")


@query("SELECT 1 AS version, count(*) AS orders FROM orders UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderstatus <> 'F'")
def store_versions(spark, sf_dir):
    """Earlier snapshots stay readable after a deletion."""
    store, rows = Store(spark, scratch(spark, "store"), "o_orderkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    store.merge(rows)
    store.merge(rows.where("o_orderstatus = 'F'").withColumn(DELETED, F.lit(True)))
    parts = [store.snapshot(v).agg(F.lit(v).alias("version"), F.count("*").alias("orders")) for v in (1, 2)]
    return parts[0].unionByName(parts[1])


def event_stream(spark, sf_dir, rows):
    """``rows`` (ts and more) as a stream, and a row ten years on that lets the watermark pass all of them."""
    folder = scratch(spark, "stream")
    last = rows.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 3650 DAYS")).alias("ts"))
    rows.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})).write.text(f"{folder}/in")
    more = {f.name: F.lit("end").cast(f.dataType) if f.dataType.simpleString() == "string" else F.lit(0).cast(f.dataType) for f in rows.schema if f.name != "ts"}
    last.select(F.to_json(F.struct("ts", *(v.alias(c) for c, v in more.items())), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})).write.mode("append").text(f"{folder}/in")
    return folder, spark.readStream.schema(rows.schema).json(f"{folder}/in")


@query("""WITH e AS (SELECT event_type AS type, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'click' THEN 60000 ELSE 600000 END AS d FROM events), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY type ORDER BY ms) >= d THEN 1 ELSE 0 END AS o FROM e), i AS (SELECT *, sum(o) OVER (PARTITION BY type ORDER BY ms ROWS UNBOUNDED PRECEDING) AS n FROM g),
 p AS (SELECT *, (row_number() OVER (PARTITION BY type, n ORDER BY ms) - 1) // 20 AS part FROM i)
SELECT type, count(*) AS messages, min(ms) AS first_ms, max(ms) + CASE WHEN count(*) = 20 THEN 0 ELSE max(d) END AS flushed_ms, CASE WHEN count(*) = 20 THEN 'full' ELSE 'gap' END AS cause FROM p WHERE type <> 'purchase' GROUP BY type, n, part
UNION ALL SELECT 'purchase', 1, epoch_us(ts) // 1000, epoch_us(ts) // 1000, 'through' FROM events WHERE event_type = 'purchase'""")
def throttled_messages(spark, sf_dir):
    """Messages held back by type: a pause of ten minutes (one for clicks) or 20 messages end a batch; purchases pass."""
    rows = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("type"), F.col("event_id").cast("string").alias("id"))
    folder, stream = event_stream(spark, sf_dir, rows)
    kinds = tuple(r.type for r in rows.select("type").distinct().collect() if r.type != "purchase")  # a few kinds
    out = streams.drained(ordered.throttled(stream, 600_000, {"click": 60_000}, 20, (*kinds, "end"), "400 days"), folder)
    return out.where("type != 'end'").select("type", "messages", "first_ms", "flushed_ms", "cause")


@query("WITH r AS (SELECT user_id, floor(value) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) SELECT 'u' || user_id AS run, max(v) AS peak, floor(avg(v) * 10000.0 + 0.5) / 10000.0 AS mean, count(*) AS held FROM r WHERE rn <= 36 GROUP BY user_id")
def ordered_ring_buffer(spark, sf_dir):
    """The last 36 samples of each user by event time, over micro-batches in any order."""
    rows = table(spark, sf_dir, "events").select("ts", F.concat(F.lit("u"), "user_id").alias("key"), F.floor("value").cast("double").alias("value"))
    folder, stream = event_stream(spark, sf_dir, rows)
    out = streams.drained(ordered.ring_metrics(stream, 36, 4_000 * 86_400_000, "400 days"), folder).where("key != 'end'")
    last = out.groupBy("key").agg(F.max_by(F.struct("peak", "mean", "held"), "ms").alias("x"))
    return last.select(F.col("key").alias("run"), "x.peak", (F.floor(F.col("x.mean") * 10000.0 + 0.5) / 10000.0).alias("mean"), "x.held")


@query("""WITH RECURSIVE e AS (SELECT user_id AS u, epoch_us(ts) // 1000 AS ms FROM events), r(u, ms) AS (SELECT u, min(ms) FROM e GROUP BY 1 UNION ALL SELECT r.u, (SELECT min(e.ms) FROM e WHERE e.u = r.u AND e.ms >= r.ms + 86400000) FROM r WHERE EXISTS (SELECT 1 FROM e WHERE e.u = r.u AND e.ms >= r.ms + 86400000))
SELECT 'u' || u AS key, ms FROM r""")
def ordered_rate_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("ts", F.concat(F.lit("u"), "user_id").alias("key"), F.col("event_id").cast("string").alias("id"))
    folder, stream = event_stream(spark, sf_dir, rows)
    return streams.drained(ordered.rate_limited(stream, 86_400_000, "400 days"), folder).where("key != 'end'").select("key", "ms")


@query("""WITH e AS (SELECT 'k' || (user_id % 4) AS key, 'c' || user_id AS id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type IN ('error', 'view') THEN 'close' ELSE 'open' END AS type, event_type = 'error' AS told FROM events),
 s AS (SELECT *, lag(type) OVER w AS was, lag(ms) OVER w AS since FROM e WINDOW w AS (PARTITION BY key, id ORDER BY ms, type)),
 c AS (SELECT *, CASE WHEN type = 'open' AND was IS DISTINCT FROM 'open' THEN 1 WHEN type = 'close' AND was = 'open' THEN -1 ELSE 0 END AS step, type = 'close' AND was = 'open' AS closed FROM s),
 a AS (SELECT *, sum(step) OVER (PARTITION BY key ORDER BY ms, type, id ROWS UNBOUNDED PRECEDING) AS active, max(ms) OVER (PARTITION BY key) AS top, row_number() OVER (PARTITION BY key, closed ORDER BY ms DESC, type DESC, id DESC) AS rn FROM c),
 g AS (SELECT key, CAST(sum(step) AS BIGINT) AS active, CAST(max(active) AS BIGINT) AS peak, count(*) FILTER (type = 'open') AS opened, count(*) FILTER (closed) AS closed, count(*) FILTER (closed AND told) AS told,
  count(*) FILTER (closed AND rn <= 500 AND ms >= top - 86400000) AS recent, CAST(floor(coalesce(avg(ms - since) FILTER (closed AND rn <= 500 AND ms >= top - 432000000), 0) + 0.5) AS BIGINT) AS mean_ms FROM a GROUP BY key)
SELECT key, active, peak, opened, closed, recent, mean_ms, floor(CASE WHEN closed = 0 THEN 1.0 ELSE told / closed END * 1000 + 0.5) / 1000 AS rate,
 CASE WHEN closed > 0 AND told / closed < 0.7 OR recent > 50 THEN 'unhealthy' WHEN closed > 0 AND told / closed < 0.9 OR recent > 20 THEN 'degraded' ELSE 'healthy' END AS health FROM g""")
def server_health(spark, sf_dir):
    """Each server's connections after its last event: open ones, peak, last 500 closings, health."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select("ts", F.concat(F.lit("k"), F.col("user_id") % 4).alias("key"), F.when(kind.isin("error", "view"), "close").otherwise("open").alias("type"), F.concat(F.lit("c"), "user_id").alias("id"), F.when(kind == "error", "error").otherwise("prune").alias("reason"))
    folder, stream = event_stream(spark, sf_dir, rows)
    out = streams.drained(ordered.health(stream, 500, 86_400_000, 432_000_000, "400 days"), folder).where("key != 'end'")
    names = ("active", "peak", "opened", "closed", "recent", "mean_ms", "rate", "health")
    return out.groupBy("key").agg(F.max_by(F.struct(*names), "ms").alias("x")).select("key", *(f"x.{n}" for n in names))


def trade_edges(spark, sf_dir):
    """Customers and suppliers who trade, in both roles: an order leads from its customer to each supplier, a supplier to
    the customers whose keys are its own."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    edges = lines.join(orders, "o_orderkey").select((F.col("o_custkey") * 2).alias("from"), (F.col("l_suppkey") * 2 + 1).alias("to"))
    back = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("from"), (F.col("s_suppkey") * 2).alias("to"))
    chain = table(spark, sf_dir, "part").select((-F.col("p_partkey") - 1).alias("from"), F.when(F.col("p_partkey") % 40 == 39, -F.col("p_partkey") + 38).otherwise(-F.col("p_partkey") - 2).alias("to"))
    return edges.unionByName(back).unionByName(chain).distinct()


EDGES = """edges AS (SELECT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1
 UNION SELECT s_suppkey * 2 + 1, s_suppkey * 2 FROM supplier WHERE s_nationkey < 5 UNION SELECT -p_partkey - 1, CASE WHEN p_partkey % 40 = 39 THEN 38 - p_partkey ELSE -p_partkey - 2 END FROM part)"""

ALL_EDGES = """edges AS (SELECT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 UNION SELECT s_suppkey * 2 + 1, s_suppkey * 2 FROM supplier UNION SELECT -p_partkey - 1, CASE WHEN p_partkey % 40 = 39 THEN 38 - p_partkey ELSE -p_partkey - 2 END FROM part)"""


@query(f"""WITH RECURSIVE {ALL_EDGES}, starts AS (SELECT a AS s FROM edges WHERE a % 2 = 1 AND a > 0),
 reach AS (SELECT s, b AS t FROM starts JOIN edges ON a = s UNION SELECT s, b FROM reach JOIN edges ON a = t),
 mutual AS (SELECT x.s AS node, x.t AS other FROM reach x JOIN reach y ON y.s = x.t AND y.t = x.s),
 suppliers AS (SELECT node, min(other) AS lead FROM mutual GROUP BY node),
 members AS (SELECT node, lead FROM suppliers UNION SELECT e.b, lead FROM edges e JOIN suppliers p ON p.node = e.a AND e.b % 2 = 0 WHERE EXISTS (SELECT 1 FROM edges f JOIN suppliers q ON q.node = f.b WHERE f.a = e.b AND q.lead = p.lead)),
 trade AS (SELECT min(node) OVER (PARTITION BY lead) AS component, node FROM members),
 rings AS (SELECT -(p_partkey // 40 * 40 + 40) AS component, -p_partkey - 1 AS node FROM part WHERE p_partkey < (SELECT (max(p_partkey) + 1) // 40 * 40 FROM part)),
 nodes AS (SELECT * FROM trade UNION ALL SELECT * FROM rings)
SELECT n.component, count(DISTINCT n.node) AS nodes, count(*) AS edges FROM nodes n JOIN edges ON a = n.node JOIN nodes m ON m.node = b AND m.component = n.component GROUP BY 1""")
def cycle_components(spark, sf_dir):
    """Strongly connected components of trade, and of rings of 40 parts: nodes and edges."""
    return Components(trade_edges(spark, sf_dir)).summary()


@query(f"WITH {EDGES} SELECT component, nodes, true AS closed FROM (SELECT -(p_partkey // 40 * 40 + 40) AS component, count(*) AS nodes FROM part WHERE p_partkey < (SELECT (max(p_partkey) + 1) // 40 * 40 FROM part) GROUP BY 1)")
def cycle_paths(spark, sf_dir):
    """Rings of parts as paths: their nodes, and whether each step is an edge and the last leads to the first."""
    edges = table(spark, sf_dir, "part").select((-F.col("p_partkey") - 1).alias("from"), F.when(F.col("p_partkey") % 40 == 39, -F.col("p_partkey") + 38).otherwise(-F.col("p_partkey") - 2).alias("to"))
    path = numbered(Components(edges).cycles())
    own = Window.partitionBy("component").orderBy("place")
    onward = F.coalesce(F.lead("node").over(own), F.first("node").over(own))
    steps = path.select("component", F.col("node").alias("from"), onward.alias("to"))
    return steps.join(edges.withColumn("known", F.lit(True)), ["from", "to"], "left").groupBy("component").agg(F.count("*").alias("nodes"), F.bool_and(F.coalesce("known", F.lit(False))).alias("closed"))
