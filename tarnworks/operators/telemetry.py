"""Usage events and runs: totals by command, model and period, trends, streaks, trailing frames, retention.

Events have ts, command, package, vendor, model, input, output and calls. Everything is a grouping or a window by a
key; nothing is collected. A window over all rows in time order is offered only where the result is one series, and
takes its series' key so that many series spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.functions.scalars import budget_severity, cost, half_up, in_range, period_key, priority_rank

TOTALS = ("input", "output", "calls")


def summed(events: DataFrame, *keys: Column | str) -> DataFrame:
    return events.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in TOTALS))


def usage_by_command(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    kept = events.where(in_range(F.col("ts_text"), since, until))
    out = summed(kept, "package", "command").withColumn("cost", half_up(cost(F.col("input"), F.col("output")), 4))
    return out.orderBy(F.desc(F.col("input") + F.col("output")), "package", "command")


def usage_by_vendor_model(events: DataFrame) -> DataFrame:
    return summed(events, "vendor", "model", "package").orderBy(F.desc(F.col("input") + F.col("output")), "vendor", "model", "package")


def usage_by_period(events: DataFrame, period: str) -> DataFrame:
    out = summed(events, period_key(F.col("ts"), period).alias("period"))
    return out.withColumn("cost", half_up(cost(F.col("input"), F.col("output")), 4)).orderBy("period")


def utilization(events: DataFrame, period: str) -> DataFrame:
    """Per period: the total, the parts by model and the parts by package, in one pass of grouping sets."""
    rows = events.withColumn("period", period_key(F.col("ts"), period))
    sets = [[F.col("period")], [F.col("period"), F.col("vendor"), F.col("model")], [F.col("period"), F.col("package")]]
    return rows.groupingSets(sets, "period", "vendor", "model", "package").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("calls").alias("calls"))


def usage_from_details(entries: DataFrame, detail: str, schema: str) -> DataFrame:
    """Entries whose detail is JSON of the schema; others are skipped."""
    first = schema.split()[0]
    return entries.withColumn("detail", F.from_json(detail, schema)).where(F.col("detail").isNotNull() & F.col(f"detail.{first}").isNotNull())


def usage_totals(events: DataFrame) -> DataFrame:
    """One row: totals and the totals of each of three packages; anything else counts as the third."""
    part = lambda name, c: F.sum(F.when(name, F.col(c)).otherwise(0))
    log, run = F.col("package") == "log", F.col("package") == "runs"
    return events.agg(*(F.sum(c).alias(f"total_{c}") for c in TOTALS), *(part(log, c).alias(f"log_{c}") for c in TOTALS), *(part(run, c).alias(f"runs_{c}") for c in TOTALS), *(part(~(log | run), c).alias(f"manifest_{c}") for c in TOTALS))


def budget_status(usage: DataFrame, budget: float, warn_at: float = 80.0) -> DataFrame:
    used = F.col("input") + F.col("output")
    return usage.withColumn("used", used).withColumn("percent", half_up(used * 100.0 / budget)).withColumn("severity", budget_severity(used, F.lit(float(budget)), warn_at))


def run_stats(runs: DataFrame) -> DataFrame:
    """One row over finished runs: success rate, averages of positive values, limit hits."""
    good = F.col("status") == "completed"
    over = lambda c: half_up(F.avg(F.when(F.col(c) > 0, F.col(c))), 2)
    return runs.where("status != 'running'").agg(F.count("*").alias("runs"), F.count_if(good).alias("succeeded"), half_up(F.count_if(good) / F.count("*"), 4).alias("success_rate"), over("turns").alias("avg_turns"), over("tokens").alias("avg_tokens"), F.count_if(F.col("status") == "limit").alias("limit_hits"))


def trouble_tasks(runs: DataFrame, least: int = 2) -> DataFrame:
    failed = F.count_if(F.col("status").isin("failed", "timeout"))
    return runs.groupBy("task").agg(failed.alias("failures"), F.count("*").alias("runs")).where(F.col("failures") >= least)


def trend_halves(runs: DataFrame, newest: int) -> DataFrame:
    """Success rate and mean tokens of the newer and older half of each series' newest runs, and their change."""
    order = Window.partitionBy("series").orderBy(F.desc("ts"), F.desc("run_id"))
    last = runs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= newest)
    last = last.withColumn("n", F.count("*").over(Window.partitionBy("series"))).withColumn("newer", F.col("rn") <= F.floor(F.col("n") / 2))
    rate = lambda side: F.count_if(side & (F.col("status") == "completed")) / F.nullif(F.count_if(side), F.lit(0))
    tokens = lambda side: F.sum(F.when(side, F.col("tokens"))) / F.nullif(F.count_if(side), F.lit(0))
    new, old = F.col("newer"), ~F.col("newer")
    out = last.groupBy("series").agg(F.count("*").alias("runs"), rate(new).alias("new_rate"), rate(old).alias("old_rate"), tokens(new).alias("new_tokens"), tokens(old).alias("old_tokens"))
    return out.select("series", "runs", half_up(F.col("new_rate") - F.col("old_rate"), 4).alias("rate_change"), half_up(F.col("new_tokens") / F.nullif(F.col("old_tokens"), F.lit(0.0)) - 1, 4).alias("token_change"))


def failure_streaks(runs: DataFrame, threshold: int = 1) -> DataFrame:
    """Length of each task's streak of failures, from its newest run backward, if at least the threshold.

    That is, failures after the last run that was none: a maximum and a count by task, which tasks combine before the
    shuffle, so a task of very many runs isn't sorted anywhere.
    """
    at = F.struct("ts", "run_id")
    last = runs.where("status != 'failed'").groupBy("task").agg(F.max(at).alias("last"))
    failed = runs.where("status = 'failed'").join(last, "task", "left").where(F.col("last").isNull() | (at > F.col("last")))
    return failed.groupBy("task").agg(F.count("*").alias("streak")).where(F.col("streak") >= threshold)


def longest_islands(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Per key, the longest run of rows in order for which the flag holds (a counter that resets)."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum((~flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("island", island).where(flag).groupBy(key, "island").count()
    return runs.groupBy(key).agg(F.max("count").alias("longest"))


def trailing_rows(rows: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """Peak and mean of the last ``n`` rows up to each row (a ring buffer)."""
    frame = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - n, 0)
    return rows.withColumns({"peak": F.max(value).over(frame), "total": F.sum(value).over(frame), "held": F.count("*").over(frame)})


def trailing_seconds(rows: DataFrame, key: str, ts: str, seconds: int, flag: Column) -> DataFrame:
    """How many flagged rows each row has within the seconds before it, itself included."""
    frame = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts))).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("recent", F.sum(flag.cast("int")).over(frame).cast("long"))


def connection_health(recent: Column, success_rate: Column) -> Column:
    return F.when((success_rate < 0.7) | (recent > 50), "unhealthy").when((success_rate < 0.9) | (recent > 20), "degraded").otherwise("healthy")


def running_peak(rows: DataFrame, key: str, order: list[str], delta: Column) -> DataFrame:
    """Running total of the changes and its greatest value so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("active", F.sum(delta).over(w)).withColumn("peak", F.max("active").over(w))


def crash_loops(crashes: DataFrame, now: str, last: int = 10, minutes: int = 5, least: int = 2) -> DataFrame:
    """Crashes of each key among its last ones that are newer than some minutes before ``now``."""
    rn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("id")))
    recent = crashes.withColumn("rn", rn).where(F.col("rn") <= last).where(F.col("ts") > F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))
    return recent.groupBy("key").agg(F.count("*").alias("crashes")).withColumn("looping", F.col("crashes") >= least)


def gap_runs(rows: DataFrame, key: str, ts: str, tie: str, gap_ms: int) -> DataFrame:
    """Numbers each row within its run: a gap of more than ``gap_ms`` starts a new one."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    opened = (F.unix_millis(F.col(ts)) - F.unix_millis(F.lag(ts).over(w)) > gap_ms).cast("int")
    island = F.sum(F.coalesce(opened, F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("island", island).withColumn("place", F.row_number().over(Window.partitionBy(key, "island").orderBy(ts, tie)))


def coalesced_batches(messages: DataFrame, key: str, ts: str, tie: str, gap_ms: int, most: int) -> DataFrame:
    """Messages gathered until none came for ``gap_ms`` or ``most`` are held: first, last and count of each batch."""
    rows = gap_runs(messages, key, ts, tie, gap_ms).withColumn("part", F.floor((F.col("place") - 1) / most))
    return rows.groupBy(key, "island", "part").agg(F.count("*").alias("messages"), F.unix_micros(F.min(ts)).alias("first_us"), F.unix_micros(F.max(ts)).alias("last_us"))


def interval_attribution(runs: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """Each run goes to the first merge of its key at or after it: later than the merge before, up to this one.

    A forward fill over the union replaces the interval join, so it takes one shuffle by key.
    """
    m = merges.select(key, "ts", F.col("id").alias("merge_id"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("run_id"))
    r = runs.select(key, "ts", F.lit(None).cast("long").alias("merge_id"), F.lit(0).alias("kind"), F.col("id").alias("run_id"))
    following = Window.partitionBy(key).orderBy("ts", "kind", "merge_id").rowsBetween(0, Window.unboundedFollowing)
    both = m.unionByName(r).withColumn("to", F.first("merge_id", ignorenulls=True).over(following))
    return both.where("kind = 0").select(key, "run_id", F.col("to").alias("merge_id"))


def fill_down(rows: DataFrame, key: str, order: list[str], marker: Column, name: str) -> DataFrame:
    """The last marker at or before each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(marker, ignorenulls=True).over(w))


def paired_with_next(rows: DataFrame, key: str, order: list[str], asks: Column, answers: Column, value: str) -> DataFrame:
    """Each asking row with the first answer after it and before the next asking row, or none."""
    w = Window.partitionBy(key).orderBy(*order)
    turn = F.sum(asks.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("turn_no", turn).where("turn_no > 0")
    first = F.min(F.when(answers, F.struct(*order, value)))
    return numbered.groupBy(key, "turn_no").agg(F.min(F.when(asks, F.struct(*order))).alias("ask"), first.alias("answer")).select(key, *(F.col(f"ask.{c}").alias(c) for c in order), F.col(f"answer.{value}").alias(value))


def retention(runs: DataFrame, now: str, days: int = 180, warn_days: int = 30) -> DataFrame:
    """Whether each run expires, is about to, or stays."""
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 86400.0
    return runs.withColumn("retention", F.when(age > days, "expired").when(age > days - warn_days, "warning").otherwise("kept"))


def run_summary(calls: DataFrame) -> DataFrame:
    """Per run: calls, distinct files changed and read, commands and failed ones."""
    of = lambda *tools: F.col("tool").isin(*tools)
    return calls.groupBy("run_id").agg(F.count("*").alias("calls"), F.count_distinct(F.when(of("write", "edit"), F.col("path"))).alias("changed"), F.count_distinct(F.when(of("read"), F.col("path"))).alias("read"), F.count_if(of("command")).alias("commands"), F.count_if(of("command") & (F.col("exit_code") != 0)).alias("failed_commands"))


def memory_peaks(samples: DataFrame, limit_bytes: int = 512 * 1024 * 1024, last: int = 360) -> DataFrame:
    """Per task: peak and last resident size over its newest samples, and whether the last is at the limit."""
    rn = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("epoch_ms")))
    kept = samples.withColumn("rn", rn).where(F.col("rn") <= last)
    out = kept.groupBy("task").agg(F.max("rss").alias("peak"), F.max_by("rss", "epoch_ms").alias("last"), F.count("*").alias("samples"))
    return out.withColumn("leaking", F.col("last") >= limit_bytes)


def issue_frequency(reports: DataFrame) -> DataFrame:
    """issue, reports: how often each issue occurs over reports with arrays of issues."""
    return reports.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("reports")).orderBy(F.desc("reports"), "issue")


def queue_order(requests: DataFrame) -> DataFrame:
    """Place of each waiting request: by priority, then first come."""
    w = Window.partitionBy("queue").orderBy(priority_rank(F.col("priority")), "enqueued_at", "id")
    return requests.withColumn("place", F.row_number().over(w))


def weekly_spend(events: DataFrame, now: str, vendor: str) -> DataFrame:
    """One row: tokens and runs of a vendor in the ISO week of ``now``."""
    week = period_key(F.col("ts"), "week") == period_key(F.lit(now).cast("timestamp"), "week")
    return events.where(week & (F.col("vendor") == vendor)).agg(F.coalesce(F.sum(F.col("input") + F.col("output")), F.lit(0).cast("long")).alias("tokens"), F.count("*").alias("events"))
