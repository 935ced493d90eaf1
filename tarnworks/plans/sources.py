"""Queries that write tables as files or streams and read them back, and parse text, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnworks.operators import items as it
from tarnworks.plans.columns import picked, picked_sql
from tarnworks.plans.tables import table
from tarnworks.session import scratch
from tarnworks.sources import readers, writers
from tarnworks.streaming import streams

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def log_folder(spark, sf_dir):
    """Events as lines of a log; every fiftieth is broken, some are blank."""
    kind = F.when(F.col("event_type") == "click", "analyze_token_usage").when(F.col("event_type") == "view", "smart_add_token_usage").otherwise("status")
    detail = F.to_json(F.struct(F.lit(1).alias("calls"), F.floor("value").cast("long").alias("inputTokens"), (F.col("user_id") % 7).alias("outputTokens"), F.when(F.col("user_id") % 2 == 0, " alpha ").alias("vendor"), F.lit(" ").alias("model")))
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), kind.alias("event"), F.lit("i").alias("itemId"), detail.alias("detail")))
    line = F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 30)).when(F.col("event_id") % 50 == 1, "").otherwise(line)
    folder = scratch(spark, "log")
    table(spark, sf_dir, "events").select(line).write.text(folder)
    return folder


@query("SELECT event_type AS type, count(*) AS entries FROM (SELECT CASE event_type WHEN 'click' THEN 'analyze_token_usage' WHEN 'view' THEN 'smart_add_token_usage' ELSE 'status' END AS event_type FROM events WHERE event_id % 50 > 1) GROUP BY 1")
def log_entries(spark, sf_dir):
    return readers.log_entries(spark, log_folder(spark, sf_dir)).groupBy(F.col("event").alias("type")).agg(F.count("*").alias("entries"))


@query("SELECT CASE event_type WHEN 'click' THEN 'analyze' ELSE 'smart-add' END AS command, CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'unknown' END AS vendor, 'unknown' AS model, CAST(sum(floor(value)) AS BIGINT) AS input, CAST(sum(user_id % 7) AS BIGINT) AS output, count(*) AS calls FROM events WHERE event_id % 50 > 1 AND event_type IN ('click', 'view') GROUP BY 1, 2")
def log_usage(spark, sf_dir):
    rows = readers.events_of_log(readers.log_entries(spark, log_folder(spark, sf_dir)))
    return rows.groupBy("command", "vendor", "model").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("calls").alias("calls"))


def run_folder(spark, sf_dir):
    """A run for each user, in files of several, each one JSON value; gzipped copies say another state. Users divisible by 3 have turns, by 6 with cache counts."""
    u = F.col("user_id")
    n = lambda c: F.floor(c).cast("long")
    turn = F.struct(n("value").alias("input"), F.lit(2).cast("long").alias("output"), F.when(u % 6 == 0, F.lit(1).cast("long")).alias("cacheReadInput"))
    usage = F.struct(F.sum(n("value")).alias("input"), F.count("*").alias("output"), F.max(n("value")).alias("cacheReadInput"))
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(usage.alias("tokenUsage"), F.collect_list(turn).alias("turns"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("startedAt"))
    folder = scratch(spark, "runs")
    for status, options in (("plain", {}), ("gzipped", {"compression": "gzip"})):
        body = F.struct(F.concat(F.lit("r"), u).alias("id"), F.lit(status).alias("status"), "startedAt", "tokenUsage", F.when(u % 3 == 0, F.col("turns")).alias("turnTokenUsage"))
        rows = runs.where("user_id % 10 != 9") if status == "plain" else runs
        rows.groupBy((u % 8).alias("file")).agg(F.to_json(F.collect_list(body)).alias("value")).select("value").repartition(8).write.mode("append").options(maxRecordsPerFile=1, **options).text(folder)
    return folder


@query("SELECT 'r' || user_id AS id, CASE WHEN user_id % 10 = 9 THEN 'gzipped' ELSE 'plain' END AS status, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started FROM events GROUP BY user_id")
def run_records(spark, sf_dir):
    return readers.run_records(spark, run_folder(spark, sf_dir)).select("id", "status", F.col("startedAt").alias("started"))


@query("""WITH g AS (SELECT user_id AS u, CAST(sum(floor(value)) AS BIGINT) AS i, count(*) AS n, CAST(max(floor(value)) AS BIGINT) AS m FROM events GROUP BY 1)
SELECT CAST(sum(i) AS BIGINT) AS input, CAST(sum(CASE WHEN u % 3 = 0 THEN 2 * n ELSE n END) AS BIGINT) AS output, CAST(sum(CASE WHEN u % 6 = 0 THEN n WHEN u % 3 = 0 THEN m ELSE m END) AS BIGINT) AS cached, CAST(sum(CASE WHEN u % 3 = 0 THEN n ELSE 1 END) AS BIGINT) AS calls, CAST(sum(CASE WHEN u % 6 = 0 THEN n WHEN u % 3 = 0 THEN n + CASE WHEN m > 0 THEN 1 ELSE 0 END ELSE 1 END) AS BIGINT) AS events FROM g""")
def run_usage(spark, sf_dir):
    rows = readers.events_of_runs(readers.run_records(spark, run_folder(spark, sf_dir)))
    return rows.agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cache_read").alias("cached"), F.sum("calls").alias("calls"), F.count("*").alias("events"))


@query("SELECT '2024-01-31' AS ts, 'analyze' AS command, 'manifest' AS package, CAST(n_nationkey AS BIGINT) AS input, 0::BIGINT AS output, 1::BIGINT AS calls FROM nation WHERE n_nationkey % 3 <> 0")
def manifest_usage(spark, sf_dir):
    k = F.col("n_nationkey")
    text = F.when(k % 3 != 0, F.concat(F.lit('{"tokenUsage":{"calls":1,"inputTokens":'), k, F.lit("}}"))).otherwise('{"other":1}')
    return readers.manifest_event(table(spark, sf_dir, "nation").select(text.alias("text")), "2024-01-31")


@query("""SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def canonical_lines(spark, sf_dir):
    folder = scratch(spark, "canonical")
    writers.canonical_json(table(spark, sf_dir, "nation"), folder, "n_nationkey")
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query("SELECT s_nationkey AS nation, 2 * count(*) AS suppliers FROM supplier GROUP BY 1")
def archived_rows(spark, sf_dir):
    folder = scratch(spark, "archive")
    for _ in range(2):
        writers.archive(table(spark, sf_dir, "supplier"), folder)
    return spark.read.json(folder).groupBy(F.col("s_nationkey").cast("int").alias("nation")).agg(F.count("*").alias("suppliers"))


@query("SELECT n_regionkey AS region, n_name AS name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 2, 'new'")
def grouped_files(spark, sf_dir):
    """A folder for each region; one is then replaced, the others stay."""
    folder, rows = scratch(spark, "groups"), table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"))
    writers.by_group(rows, folder, "region")
    writers.by_group(rows.where("region = 2").limit(1).withColumn("name", F.lit("new")), folder, "region")
    return spark.read.json(folder).select("region", "name")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100")
def capped_history(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id")
    return writers.capped(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "event_id", 100)


@query("""SELECT 'R' || r_regionkey AS id, NULL AS parent_id, 'epic' AS level, r_name AS title, 'x,y' AS tags FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'feature', n_name, '' FROM nation""")
def markdown_tree(spark, sf_dir):
    """Regions and nations as Markdown files in nested folders, and read back."""
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.concat(F.lit("R"), "r_regionkey", F.lit("/index.md")).alias("path"), F.lit("epic").alias("level"), F.col("r_name").alias("title"), F.array(F.lit("x"), F.lit("y")).alias("tags"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey", F.lit("/N"), "n_nationkey", F.lit("/index.md")), F.lit("feature"), "n_name", empty)
    rows = region.union(nation).withColumns({"status": F.lit("pending"), "priority": none, "description": none, "blocked_by": empty, "acceptance": empty})
    folder = scratch(spark, "tree")
    writers.text_files(writers.markdown(rows).join(rows.select("id", "path"), "id"), folder)
    return readers.with_parents(readers.folder_tree(spark, folder)).select("id", "parent_id", "level", "title", F.array_join("tags", ",").alias("tags"))


@query("""WITH f AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'src/a' || p_partkey || '.ts' WHEN 1 THEN 'dist/b' || p_partkey || '.js' WHEN 2 THEN 'src/gen/c' || p_partkey || '.py' WHEN 3 THEN 'src/keep.gen/d' || p_partkey || '.md' ELSE 'e' || p_partkey || '.log' END AS path FROM part WHERE p_partkey < 60)
SELECT path, CASE WHEN k % 4 = 0 THEN 0 ELSE 2 * (k % 4) + 1 END AS size, CASE WHEN k % 4 = 0 THEN 0 ELSE k % 4 + 1 END AS lines, CASE k % 5 WHEN 0 THEN 'TypeScript' WHEN 3 THEN 'Markdown' ELSE 'Other' END AS language FROM f WHERE k % 5 IN (0, 3) OR path = 'e4.log'""")
def file_inventory(spark, sf_dir):
    """Files of a few lines or none, some of them ignored."""
    k = F.col("p_partkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("src/a"), k, F.lit(".ts"))).when(k % 5 == 1, F.concat(F.lit("dist/b"), k, F.lit(".js"))).when(k % 5 == 2, F.concat(F.lit("src/gen/c"), k, F.lit(".py"))).when(k % 5 == 3, F.concat(F.lit("src/keep.gen/d"), k, F.lit(".md"))).otherwise(F.concat(F.lit("e"), k, F.lit(".log")))
    text = F.when(k % 4 == 0, "").otherwise(F.concat(F.repeat(F.lit("x\n"), (k % 4).cast("int")), F.lit("y")))
    folder = scratch(spark, "files")
    writers.text_files(table(spark, sf_dir, "part").where("p_partkey < 60").select(path.alias("path"), text.alias("text")), folder)
    rows = readers.inventory(spark, folder, rules=["# generated", "gen/", "*.log", "!e4.log"])
    return rows.select(F.regexp_extract("path", "files-[0-9a-f]+/(.*)$", 1).alias("path"), F.col("size").cast("long").alias("size"), "lines", "language")


@query("SELECT user_id, event_id, 'u' || user_id AS author FROM events WHERE event_type = 'purchase' AND event_id % 7 <> 0")
def merge_records(spark, sf_dir):
    """Purchases as records of a history, one text for each user; every seventh lacks fields."""
    e = F.col("event_id")
    record = F.when(e % 7 == 0, F.concat_ws("\x1f", F.lit("short"), e)).otherwise(F.concat_ws("\x1f", e.cast("string"), F.lit("p q"), F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("u"), "user_id"), F.lit("subject"), F.lit("body\n")))
    logs = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.array_join(F.collect_list(record), "\x1e\n").alias("text"))
    rows = readers.merge_commits(logs)
    return rows.select(F.substring("author", 2, 20).cast("long").alias("user_id"), F.col("sha").cast("long").alias("event_id"), "author")


@query("""WITH l AS (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS mark FROM events), f AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS sha FROM l)
SELECT CAST(sha AS VARCHAR) AS sha, CASE WHEN event_type = 'view' THEN 'R' ELSE 'M' END AS status, CASE WHEN event_type = 'view' THEN 'new' || event_id ELSE 'f' || event_id END AS path, CASE WHEN event_type = 'view' THEN 'old' || event_id END AS old_path FROM f WHERE mark IS NULL AND sha IS NOT NULL""")
def changed_files(spark, sf_dir):
    e = F.col("event_id")
    line = F.when(F.col("event_type") == "purchase", F.concat(F.lit("commit "), e)).when(F.col("event_type") == "view", F.concat(F.lit("R090\told"), e, F.lit("\tnew"), e)).otherwise(F.concat(F.lit("M\tf"), e))
    return readers.changed_files(table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), e.alias("n"), line.alias("line")))


@query("SELECT CAST(sum(CASE WHEN l_linenumber = 2 THEN 0 ELSE l_quantity END) AS BIGINT) AS added, CAST(sum(CASE WHEN l_linenumber = 2 THEN 0 ELSE l_linenumber END) AS BIGINT) AS removed FROM lineitem")
def line_totals(spark, sf_dir):
    n = F.col("l_linenumber")
    line = F.when(n == 2, "-\t-\timage.png").otherwise(F.concat_ws("\t", F.col("l_quantity").cast("long").cast("string"), n.cast("string"), F.lit("a.ts")))
    return readers.line_totals(table(spark, sf_dir, "lineitem").select(line.alias("line")))


@query("SELECT 'x.org/n' || n_nationkey AS path, 'v1.' || n_regionkey || '.0' AS version FROM nation UNION ALL SELECT 'y.dev/r' || r_regionkey || '/sub', 'v2.0.0-rc' FROM region")
def module_requirements(spark, sf_dir):
    block = F.concat(F.lit("module m\n\ngo 1.22\n\nrequire (\n"), F.array_join(F.collect_list(F.concat(F.lit("\tx.org/n"), "n_nationkey", F.lit(" v1."), "n_regionkey", F.lit(".0 // indirect"))), "\n"), F.lit("\n)\n"))
    first = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(block.alias("text")).select("text")
    second = table(spark, sf_dir, "region").select(F.concat(F.lit("module z\nrequire y.dev/r"), "r_regionkey", F.lit("/sub v2.0.0-rc\n")))
    return readers.module_requirements(first.union(second))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey // 10 > 0 AND p_partkey // 10 IN (SELECT p_partkey FROM part) THEN CAST(p_partkey // 10 AS VARCHAR) WHEN p_partkey // 10 = 0 THEN '0' END AS parent_id, CASE p_type WHEN 'ECONOMY' THEN 'epic' WHEN 'PROMO' THEN 'feature' ELSE 'task' END AS level, CASE WHEN p_size > 25 THEN 'completed' ELSE 'pending' END AS status, p_name AS title FROM part")
def tracker_items(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumns({"parent": F.floor(F.col("p_partkey") / 10).cast("long"), "state": F.when(F.col("p_size") > 25, "Done").otherwise("Odd")})
    return readers.tracker_items(rows, "p_partkey", "parent", "p_type", {"economy": "epic", "promo": "feature"}, "state", {"done": "completed"}, "p_name")


@query("SELECT CASE WHEN p_partkey = 0 THEN 'a/prd.json' ELSE 'a/prd_b' || p_partkey || '_2024-0' || (p_partkey % 9 + 1) || '-11.json' END AS path, CASE WHEN p_partkey > 0 THEN 'b' || p_partkey END AS branch, CASE WHEN p_partkey > 0 THEN '2024-0' || (p_partkey % 9 + 1) || '-11' END AS date FROM part WHERE p_partkey % 3 = 0")
def dated_documents(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.when(k == 0, "a/prd.json").when(k % 3 == 0, F.concat(F.lit("a/prd_b"), k, F.lit("_2024-0"), k % 9 + 1, F.lit("-11.json"))).otherwise(F.concat(F.lit("a/notes"), k, F.lit(".json")))
    return readers.dated_documents(table(spark, sf_dir, "part").select(path.alias("path")))


@query("WITH c AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS rn, p_name FROM part) SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE p_name || '-' || rn END AS p_name FROM c")
def numbered_duplicates(spark, sf_dir):
    return writers.numbered_duplicates(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name"), "p_type", "p_name", "p_partkey").select("p_partkey", "p_name")


@query("SELECT 'tests' AS source, p_name AS name, 'test' AS kind, p_brand AS file, NULL::VARCHAR AS detail FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'docs', p_type, 'doc', NULL, p_name FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT 'packages', s_name, NULL, NULL, NULL FROM supplier")
def scan_results(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tests = part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("name"), F.lit("test").alias("kind"), F.col("p_brand").alias("file"))
    docs = part.where("p_partkey % 3 = 1").select(F.col("p_type").alias("name"), F.lit("doc").alias("kind"), F.col("p_name").alias("detail"))
    return readers.scan_results(tests=tests, docs=docs, packages=table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'a:1:new' ELSE 'b:1:old,a:1:new' END AS links FROM nation")
def upserted_links(spark, sf_dir):
    link = lambda s, v: F.struct(F.lit(s).alias("system"), F.lit("1").alias("work_item"), F.lit(v).alias("state"))
    held = F.when(F.col("n_nationkey") % 2 == 0, F.array(link("a", "old"))).otherwise(F.array(link("b", "old")))
    out = it.upserted(held, "a", "1", link("a", "new"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array_join(F.transform(out, lambda x: F.concat_ws(":", x["system"], x["work_item"], x["state"])), ",").alias("links"))


def event_folder(spark, sf_dir):
    """Events as JSON lines for a stream: clicks are tool calls, errors failures."""
    kind = F.when(F.col("event_type") == "click", "tool_use").when(F.col("event_type") == "error", "failure").otherwise(F.col("event_type"))
    line = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.concat(F.lit("u"), "user_id").alias("run"), kind.alias("type"), F.floor("value").cast("long").alias("input"), F.lit(1).alias("output"))
    folder = scratch(spark, "stream")
    rows = table(spark, sf_dir, "events").select(F.to_json(line).alias("value"))
    rows.union(rows.limit(3).select(F.lit("not json"))).repartition(2).write.text(f"{folder}/in")
    return folder


@query("SELECT 'u' || user_id AS run, CAST(sum(floor(value)) AS BIGINT) AS input, count(*) AS output, count(*) FILTER (event_type = 'click') AS tool_calls FROM events GROUP BY user_id")
def stream_run_totals(spark, sf_dir):
    folder = event_folder(spark, sf_dir)
    return streams.drained(streams.run_totals(streams.event_stream(spark, f"{folder}/in")), folder, "complete").select("run", "input", "output", "tool_calls")


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start_us, CASE event_type WHEN 'click' THEN 'tool_use' WHEN 'error' THEN 'failure' ELSE event_type END AS type, CAST(sum(floor(value)) AS BIGINT) AS input FROM events GROUP BY 1, 2")
def stream_usage_windows(spark, sf_dir):
    folder = event_folder(spark, sf_dir)
    rows = streams.drained(streams.usage_windows(streams.event_stream(spark, f"{folder}/in")), folder, "complete")
    return rows.select(F.unix_micros("window.start").alias("start_us"), "type", "input")


@query("""WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'tool_use' WHEN 'error' THEN 'failure' ELSE event_type END AS type, ts FROM events), g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY type ORDER BY ts)) >= 600000000 THEN 1 ELSE 0 END AS o FROM e), i AS (SELECT *, sum(o) OVER (PARTITION BY type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT type, epoch_us(min(ts)) AS start_us, count(*) AS messages FROM i GROUP BY type, n""")
def stream_message_batches(spark, sf_dir):
    folder = event_folder(spark, sf_dir)
    rows = streams.drained(streams.message_batches(streams.event_stream(spark, f"{folder}/in"), "10 minutes"), folder, "complete")
    return rows.select("type", F.unix_micros("session_window.start").alias("start_us"), "messages")


@query("WITH r AS (SELECT user_id, floor(value) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) SELECT 'u' || user_id AS run, max(v) AS peak, floor(avg(v) * 10000.0 + 0.5) / 10000.0 AS mean, count(*) AS held FROM r WHERE rn <= 36 GROUP BY user_id")
def stream_ring_buffer(spark, sf_dir):
    folder = event_folder(spark, sf_dir)
    rows = streams.drained(streams.ring_buffer(streams.event_stream(spark, f"{folder}/in"), "run", "input", 36), folder, "update")
    return rows.select("run", "peak", (F.floor(F.col("mean") * 10000.0 + 0.5) / 10000.0).alias("mean"), "held")


@query("""WITH RECURSIVE e AS (SELECT user_id AS u, epoch_ms(ts) AS ms FROM events), r(u, ms) AS (SELECT u, min(ms) FROM e GROUP BY 1 UNION ALL SELECT r.u, (SELECT min(e.ms) FROM e WHERE e.u = r.u AND e.ms >= r.ms + 86400000) FROM r WHERE EXISTS (SELECT 1 FROM e WHERE e.u = r.u AND e.ms >= r.ms + 86400000))
SELECT 'u' || u AS run, count(*) AS passed FROM r GROUP BY 1""")
def stream_rate_limited(spark, sf_dir):
    folder = event_folder(spark, sf_dir)
    rows = streams.drained(streams.rate_limited(streams.event_stream(spark, f"{folder}/in"), "run", 86_400_000), folder)
    return rows.groupBy("run").agg(F.count("*").alias("passed"))


@query("""WITH g AS (SELECT user_id AS u, ts, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 14400000 THEN 1 ELSE 0 END AS o FROM events), i AS (SELECT *, sum(o) OVER (PARTITION BY u ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g), p AS (SELECT *, (row_number() OVER (PARTITION BY u, n ORDER BY ts) - 1) // 4 AS part FROM i),
 b AS (SELECT u, n, part, count(*) AS c, max(ts) AS last FROM p GROUP BY 1, 2, 3), f AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY last DESC) AS rn FROM b)
SELECT 'u' || u AS run, c AS messages, count(*) AS batches FROM f WHERE rn > 1 GROUP BY 1, 2""")
def stream_capped_batches(spark, sf_dir):
    folder = event_folder(spark, sf_dir)
    rows = streams.drained(streams.capped_batches(streams.event_stream(spark, f"{folder}/in"), "run", 4, 14_400_000), folder)
    return rows.groupBy("run", "messages").agg(F.count("*").alias("batches"))


@query("SELECT 'k' || (user_id % 4) AS kind, count(*) FILTER (event_type <> 'error' AND event_type <> 'view') AS opened, count(*) FILTER (event_type IN ('error', 'view')) AS closed, count(*) FILTER (event_type = 'error') AS failed, floor(avg(floor(value)) FILTER (event_type IN ('error', 'view')) * 10000.0 + 0.5) / 10000.0 AS mean_ms FROM events GROUP BY 1")
def connection_counters(spark, sf_dir):
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("user_id") % 4).alias("kind"), F.when(kind.isin("error", "view"), "close").otherwise("open").alias("type"), F.when(kind == "error", "error").alias("reason"), F.floor("value").alias("ms"))
    return streams.connection_events(rows).withColumn("mean_ms", F.floor(F.col("mean_ms") * 10000.0 + 0.5) / 10000.0)


VENDOR = ('{"type":"item.completed","item":{"type":"command_execution","command":"ls"}}', '{"type":"turn.completed","usage":{"input_tokens":5,"output_tokens":2}}', "plain words", '{"item":{"type":"agent_message"}}', '{"type":"usage","usage":{"prompt_tokens":3,"completion_tokens":1}}')


@query("""SELECT 'r' || user_id AS run, CASE event_id % 5 WHEN 0 THEN 'tool_use' WHEN 2 THEN 'text' WHEN 3 THEN 'message' ELSE 'usage' END AS type, count(*) AS n, CAST(sum(CASE event_id % 5 WHEN 1 THEN 5 WHEN 4 THEN 3 ELSE 0 END) AS BIGINT) AS input, CAST(sum(CASE event_id % 5 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END) AS BIGINT) AS output FROM events GROUP BY 1, 2""")
def vendor_lines(spark, sf_dir):
    rows = streams.vendor_lines(table(spark, sf_dir, "events").select(F.concat(F.lit("r"), "user_id").alias("run"), picked(F.col("event_id"), *VENDOR).alias("text")))
    return rows.groupBy("run", "type").agg(F.count("*").alias("n"), F.sum("input").alias("input"), F.sum("output").alias("output"))


@query("SELECT 'u' || user_id AS run FROM events GROUP BY user_id HAVING user_id % 5 = 0 OR epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) > 36000")
def stale_runs(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    rows = last.select(F.concat(F.lit("u"), "user_id").alias("run"), F.lit("running").alias("status"), F.when(F.col("user_id") % 5 != 0, F.col("last")).alias("last_activity"))
    return streams.stale_runs(rows, "2024-01-31 00:00:00", 600).select("run")


@query("SELECT 'p' || o_orderkey AS path, CASE o_orderkey % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS change FROM orders WHERE o_orderkey % 5 <> 3 AND o_orderkey % 5 <> 4")
def changed_runs(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = lambda n, size: table(spark, sf_dir, "orders").where(k % 5 != n).select(F.concat(F.lit("p"), k).alias("path"), F.col("o_orderdate").alias("modified"), size.alias("size"))
    return streams.changed_runs(rows(0, F.lit(1)), rows(1, F.when(k % 5 == 2, 2).otherwise(1)))


@query("SELECT user_id AS k, CAST(sum(floor(value)) AS BIGINT) AS v FROM events GROUP BY 1")
def stream_upserts(spark, sf_dir):
    """Two batches of events into a table of totals."""
    folder, rows = scratch(spark, "upserts"), table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", F.floor("value").cast("long").alias("v"))
    save = streams.upserting(folder, "k", ("v",))
    save(rows.where("event_id % 2 = 0"), 0)
    save(rows.where("event_id % 2 = 1"), 1)
    return spark.read.parquet(f"{folder}/v1")
