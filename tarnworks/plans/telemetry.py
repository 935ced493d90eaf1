"""Queries over events as usage and runs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnworks.functions.scalars import half_up, heartbeat_status, nearest_rank
from tarnworks.operators import telemetry as op
from tarnworks.plans.tables import NOW, RUNS, TOKEN_EVENTS, runs, table, token_events

QUERIES, SQL = {}, {}
COST = "floor((input / 1e6 * 3.0 + output / 1e6 * 15.0) * 10000.0 + 0.5) / 10000.0"
SUMS = "CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(calls) AS BIGINT) AS calls"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"WITH {TOKEN_EVENTS}, g AS (SELECT package, command, {SUMS} FROM token_events WHERE ts_text >= '2024-01-03T00:00:00Z' AND ts_text <= '2024-01-27T23:59:59Z' GROUP BY 1, 2) SELECT *, {COST} AS cost FROM g")
def usage_by_command(spark, sf_dir):
    return op.usage_by_command(token_events(spark, sf_dir), "2024-01-03T00:00:00Z", "2024-01-27T23:59:59Z")


@query(f"WITH {TOKEN_EVENTS} SELECT vendor, model, package, {SUMS} FROM token_events GROUP BY 1, 2, 3")
def usage_by_vendor_model(spark, sf_dir):
    return op.usage_by_vendor_model(token_events(spark, sf_dir))


PERIODS = {"day": "strftime(ts, '%Y-%m-%d')", "week": "CAST(isoyear(ts) AS VARCHAR) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0')", "month": "strftime(ts, '%Y-%m')"}
for _period, _key in PERIODS.items():

    def _by_period(spark, sf_dir, period=_period):
        return op.usage_by_period(token_events(spark, sf_dir), period)

    QUERIES[f"usage_by_{_period}"] = _by_period
    SQL[f"usage_by_{_period}"] = f"WITH {TOKEN_EVENTS}, g AS (SELECT {_key} AS period, {SUMS} FROM token_events GROUP BY 1) SELECT *, {COST} AS cost FROM g"


@query(f"WITH {TOKEN_EVENTS} SELECT {PERIODS['week']} AS period, vendor, model, package, {SUMS} FROM token_events GROUP BY GROUPING SETS ((period), (period, vendor, model), (period, package))")
def utilization_by_week(spark, sf_dir):
    return op.utilization(token_events(spark, sf_dir), "week")


@query(f"""WITH {TOKEN_EVENTS} SELECT CAST(sum(input) AS BIGINT) AS total_input, CAST(sum(output) AS BIGINT) AS total_output, CAST(sum(calls) AS BIGINT) AS total_calls,
 {', '.join(f"CAST(sum(CASE WHEN package = '{p}' THEN {c} ELSE 0 END) AS BIGINT) AS {p}_{c}" for p in ("log", "runs", "manifest") for c in ("input", "output", "calls"))} FROM token_events""")
def usage_totals(spark, sf_dir):
    return op.usage_totals(token_events(spark, sf_dir))


@query("SELECT event_type AS command, count(*) AS entries, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 1")
def usage_from_json(spark, sf_dir):
    found = op.usage_from_details(table(spark, sf_dir, "events"), "props", "k bigint")
    return found.groupBy(F.col("event_type").alias("command")).agg(F.count("*").alias("entries"), F.sum("detail.k").alias("k"))


@query(f"""WITH {TOKEN_EVENTS}, g AS (SELECT package, command, {SUMS} FROM token_events GROUP BY 1, 2)
SELECT *, input + output AS used, CAST(floor((input + output) * 100.0 / 1200000.0 + 0.5) AS BIGINT) AS percent,
 CASE WHEN (input + output) * 100.0 / 1200000.0 >= 100 THEN 'exceeded' WHEN (input + output) * 100.0 / 1200000.0 >= 80 THEN 'warning' ELSE 'ok' END AS severity FROM g""")
def budget_status(spark, sf_dir):
    return op.budget_status(op.summed(token_events(spark, sf_dir), "package", "command"), 1_200_000)


@query(f"""WITH {RUNS} SELECT count(*) AS runs, count(*) FILTER (status = 'completed') AS succeeded, floor(count(*) FILTER (status = 'completed') / count(*) * 10000.0 + 0.5) / 10000.0 AS success_rate,
 floor(avg(turns) FILTER (turns > 0) * 100.0 + 0.5) / 100.0 AS avg_turns, floor(avg(tokens) FILTER (tokens > 0) * 100.0 + 0.5) / 100.0 AS avg_tokens, count(*) FILTER (status = 'limit') AS limit_hits FROM runs WHERE status <> 'running'""")
def run_stats(spark, sf_dir):
    return op.run_stats(runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT task, count(*) FILTER (status IN ('failed', 'timeout')) AS failures, count(*) AS runs FROM runs GROUP BY 1 HAVING failures >= 2")
def trouble_tasks(spark, sf_dir):
    return op.trouble_tasks(runs(spark, sf_dir))


@query(f"""WITH {RUNS}, s AS (SELECT *, task % 10 AS series FROM runs), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC, run_id DESC) AS rn FROM s),
 k AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM r WHERE rn <= 40), h AS (SELECT *, rn <= floor(n / 2) AS newer FROM k),
 g AS (SELECT series, count(*) AS runs, count(*) FILTER (newer AND status = 'completed') / nullif(count(*) FILTER (newer), 0) AS nr, count(*) FILTER (NOT newer AND status = 'completed') / nullif(count(*) FILTER (NOT newer), 0) AS orr,
 sum(tokens) FILTER (newer) / nullif(count(*) FILTER (newer), 0) AS nt, sum(tokens) FILTER (NOT newer) / nullif(count(*) FILTER (NOT newer), 0) AS ot FROM h GROUP BY 1)
SELECT series, runs, floor((nr - orr) * 10000.0 + 0.5) / 10000.0 AS rate_change, floor((nt / nullif(ot, 0) - 1) * 10000.0 + 0.5) / 10000.0 AS token_change FROM g""")
def run_trend_halves(spark, sf_dir):
    return op.trend_halves(runs(spark, sf_dir).withColumn("series", F.col("task") % 10), 40)


@query(f"""WITH {RUNS}, r AS (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY ts DESC, run_id DESC ROWS UNBOUNDED PRECEDING) AS others FROM runs)
SELECT task, count(*) AS streak FROM r WHERE others = 0 GROUP BY 1 HAVING count(*) >= 1""")
def failure_streaks(spark, sf_dir):
    return op.failure_streaks(runs(spark, sf_dir))


@query(f"""WITH {RUNS}, r AS (SELECT *, sum(CASE WHEN NOT status = 'limit' THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING) AS island FROM runs),
 g AS (SELECT task, island, count(*) AS c FROM r WHERE status = 'limit' GROUP BY 1, 2) SELECT task, max(c) AS longest FROM g GROUP BY 1""")
def spinning_tasks(spark, sf_dir):
    return op.longest_islands(runs(spark, sf_dir), "task", ["ts", "run_id"], F.col("status") == "limit")


@query("""WITH c AS (SELECT role, length(text) AS n FROM conversations) SELECT role, median(n) AS median, list_sort(list(n))[CAST(least(count(*), floor(count(*) * 0.9) + 1) AS BIGINT)] AS p90 FROM c GROUP BY 1""")
def turns_p90_median(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", F.length("text").cast("long").alias("n"))
    return rows.groupBy("role").agg(F.median("n").alias("median"), nearest_rank(F.collect_list("n"), 0.9).alias("p90"))


@query(f"""WITH {TOKEN_EVENTS} SELECT event_id, user_id, max(input) OVER w AS peak, CAST(sum(input) OVER w AS BIGINT) AS total, count(*) OVER w AS held FROM token_events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)""")
def ring_buffer_metrics(spark, sf_dir):
    return op.trailing_rows(token_events(spark, sf_dir), "user_id", ["ts", "event_id"], "input", 36).select("event_id", "user_id", "peak", "total", "held")


@query("""WITH r AS (SELECT event_id, user_id, event_type, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM events)
SELECT event_id, recent, CASE WHEN recent > 50 THEN 'unhealthy' WHEN recent > 20 THEN 'degraded' ELSE 'healthy' END AS health FROM r""")
def trailing_hour_health(spark, sf_dir):
    rows = op.trailing_seconds(table(spark, sf_dir, "events"), "user_id", "ts", 3600, F.col("event_type") == "error")
    return rows.select("event_id", "recent", op.connection_health(F.col("recent"), F.lit(1.0)).alias("health"))


@query("""WITH d AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS d FROM events),
 a AS (SELECT *, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM d)
SELECT event_id, active, max(active) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM a""")
def running_peak(spark, sf_dir):
    delta = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    return op.running_peak(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], delta).select("event_id", "active", "peak")


@query("""WITH r AS (SELECT user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'error')
SELECT key, count(*) AS crashes, count(*) >= 2 AS looping FROM r WHERE rn <= 10 AND ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7200 MINUTES GROUP BY 1""")
def crash_loops(spark, sf_dir):
    crashes = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return op.crash_loops(crashes, "2024-01-30 00:00:00", minutes=7200)


GAPS = """g AS (SELECT *, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {gap} THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS o FROM events),
 i AS (SELECT *, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS place FROM i)"""


@query(f"WITH {GAPS.format(gap=14_400_000)} SELECT user_id, count(*) FILTER (place % 3 = 0) AS fired, max(place) AS longest FROM p GROUP BY 1")
def click_runs(spark, sf_dir):
    rows = op.gap_runs(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 14_400_000)
    return rows.groupBy("user_id").agg(F.count_if(F.col("place") % 3 == 0).alias("fired"), F.max("place").cast("long").alias("longest"))


@query(f"""WITH {GAPS.format(gap=14_400_000)} SELECT user_id, island, CAST((place - 1) // 4 AS BIGINT) AS part, count(*) AS messages, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM p GROUP BY 1, 2, 3""")
def coalesced_batches(spark, sf_dir):
    return op.coalesced_batches(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 14_400_000, 4)


@query("""SELECT r.user_id, r.event_id AS run_id, (SELECT m.event_id FROM events m WHERE m.event_type = 'purchase' AND m.user_id = r.user_id AND m.ts >= r.ts ORDER BY m.ts, m.event_id LIMIT 1) AS merge_id FROM events r WHERE r.event_type <> 'purchase'""")
def interval_attribution(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("id", F.col("event_id"))
    return op.interval_attribution(e.where("event_type != 'purchase'"), e.where("event_type = 'purchase'"), "user_id")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS asked_at FROM conversations""")
def fill_down(spark, sf_dir):
    rows = op.fill_down(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], F.when(F.col("role") == "user", F.col("turn")), "asked_at")
    return rows.select("conv_id", "turn", "asked_at")


@query("""WITH t AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn_no FROM events)
SELECT user_id, min(CASE WHEN event_type = 'click' THEN event_id END) AS ask_id, arg_min(event_id, (ts, event_id)) FILTER (event_type = 'view') AS answer_id FROM t WHERE turn_no > 0 GROUP BY user_id, turn_no""")
def result_pairing(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("answer_id", F.col("event_id"))
    out = op.paired_with_next(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "view", "answer_id")
    return out.select("user_id", F.col("event_id").alias("ask_id"), "answer_id")


@query(f"""SELECT CASE WHEN a > 20 THEN 'expired' WHEN a > 10 THEN 'warning' ELSE 'kept' END AS retention, count(*) AS runs FROM (SELECT (epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 86400.0 AS a FROM events) GROUP BY 1""")
def retention_split(spark, sf_dir):
    return op.retention(table(spark, sf_dir, "events"), NOW, 20, 10).groupBy("retention").agg(F.count("*").alias("runs"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS accepted, count(*) FILTER (event_type = 'error') AS rejected, count(*) FILTER (event_type = 'view') AS deferred FROM events GROUP BY 1""")
def decision_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["purchase", "error", "view"]).count()
    return rows.select("user_id", *(F.coalesce(F.col(a), F.lit(0)).alias(b) for a, b in (("purchase", "accepted"), ("error", "rejected"), ("view", "deferred"))))


@query("""SELECT conv_id AS run_id, count(*) AS calls, count(DISTINCT CASE WHEN role = 'assistant' THEN text END) AS changed, count(DISTINCT CASE WHEN role = 'user' THEN text END) AS read,
 count(*) FILTER (role = 'system') AS commands, count(*) FILTER (role = 'system' AND turn <> 0) AS failed_commands FROM conversations GROUP BY 1""")
def run_summary(spark, sf_dir):
    tool = F.when(F.col("role") == "assistant", "write").when(F.col("role") == "user", "read").otherwise("command")
    return op.run_summary(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), tool.alias("tool"), F.col("text").alias("path"), F.col("turn").alias("exit_code")))


@query(f"""WITH {TOKEN_EVENTS}, w AS (SELECT vendor, {PERIODS['week']} AS week, {SUMS} FROM token_events GROUP BY 1, 2)
SELECT vendor, week, input + output AS tokens, input + output - lag(input + output) OVER (PARTITION BY vendor ORDER BY week) AS change FROM w""")
def weekly_spend_change(spark, sf_dir):
    rows = op.usage_by_period(token_events(spark, sf_dir).where("vendor = 'alpha'"), "week").withColumn("vendor", F.lit("alpha"))
    rows = rows.unionByName(op.usage_by_period(token_events(spark, sf_dir).where("vendor = 'beta'"), "week").withColumn("vendor", F.lit("beta")))
    tokens = F.col("input") + F.col("output")
    return rows.select("vendor", F.col("period").alias("week"), tokens.alias("tokens"), (tokens - F.lag(tokens).over(Window.partitionBy("vendor").orderBy("period"))).alias("change"))


@query(f"""WITH b AS (SELECT user_id, CAST(floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(max(ts))) AS BIGINT) AS silent FROM events GROUP BY 1)
SELECT user_id, silent, CASE WHEN silent >= 120 THEN 'unresponsive' WHEN silent >= 60 THEN 'warning' ELSE 'healthy' END AS status FROM b""")
def heartbeats(spark, sf_dir):
    silent = F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.max("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(silent.alias("silent")).withColumn("status", heartbeat_status(F.col("silent")))


@query(f"""WITH {TOKEN_EVENTS}, g AS (SELECT model, CAST(sum(input) AS BIGINT) AS w FROM token_events GROUP BY 1)
SELECT model, floor((sum(w) OVER (ORDER BY w DESC, model ROWS UNBOUNDED PRECEDING) - w) / sum(w) OVER () * 10000.0 + 0.5) / 10000.0 AS start_share, floor(sum(w) OVER (ORDER BY w DESC, model ROWS UNBOUNDED PRECEDING) / sum(w) OVER () * 10000.0 + 0.5) / 10000.0 AS end_share FROM g""")
def cumulative_shares(spark, sf_dir):
    g = token_events(spark, sf_dir).groupBy("model").agg(F.sum("input").alias("w"))  # a row for each model
    upto, all_ = F.sum("w").over(Window.orderBy(F.desc("w"), "model").rowsBetween(Window.unboundedPreceding, 0)), F.sum("w").over(Window.partitionBy(F.lit(1)))
    return g.select("model", half_up((upto - F.col("w")) / all_, 4).alias("start_share"), half_up(upto / all_, 4).alias("end_share"))


@query(f"WITH {TOKEN_EVENTS} SELECT CAST(sum(input + output) AS BIGINT) AS tokens, count(*) AS events FROM token_events WHERE vendor = 'alpha' AND isoyear(ts) = 2024 AND week(ts) = 3")
def weekly_spend(spark, sf_dir):
    return op.weekly_spend(token_events(spark, sf_dir), "2024-01-18 12:00:00", "alpha")
