"""Streams of events: windowed usage, run totals, message batches, ring buffers, rate limits, changed files.

Built-in stateful operators carry what they can, with watermarks that bound their state. Counts that cap a batch,
ring buffers and rate limits keep state of fixed size for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnworks.operators import sync

EVENT_SCHEMA = "ts timestamp, run string, type string, tool string, input bigint, output bigint"


def event_stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files: int = 100) -> DataFrame:
    """JSON lines as they arrive in a folder; lines that aren't JSON give nulls and are left out."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    return rows.where("ts is not null")


def usage_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tokens and events by window and type, closed once the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.count("*").alias("events"))


def run_totals(events: DataFrame) -> DataFrame:
    """Running totals of each run: tokens, tool calls, failures, last activity."""
    return events.groupBy("run").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.count_if(F.col("type") == "tool_use").alias("tool_calls"), F.count_if(F.col("type") == "error").alias("failures"), F.max("ts").alias("last_activity"))


def message_batches(messages: DataFrame, gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Messages of each type gathered until none came for the gap."""
    return messages.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "type").agg(F.count("*").alias("messages"))


def in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of a micro-batch by time: they come in several Arrow batches, each in any order.

    Order holds within a micro-batch; ``tarnworks.streaming.ordered`` also orders rows that come later, by watermark.
    """
    return pd.concat(list(batches)).sort_values("ts", kind="stable")


def ring_buffer(samples: DataFrame, key: str, value: str, size: int = 360) -> DataFrame:
    """After each micro-batch, peak, mean and count over the last ``size`` samples of each key."""
    kind = samples.schema[key].dataType.simpleString()

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        held = (held + [float(v) for v in in_order(batches)[value]])[-size:]
        state.update((held,))
        yield pd.DataFrame({key: [name[0]], "peak": [max(held)], "mean": [sum(held) / len(held)], "held": [len(held)]})

    return samples.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, peak double, mean double, held long", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def rate_limited(calls: DataFrame, key: str, least_ms: int = 500) -> DataFrame:
    """Calls of each key that come at least ``least_ms`` after the last one let through."""
    kind = calls.schema[key].dataType.simpleString()

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, passed = state.get[0] if state.exists else None, []
        for ts in in_order(batches)["ts"]:
            ms = int(ts.value // 1_000_000)
            if last is None or ms - last >= least_ms:
                last = ms
                passed.append(ts)
        if passed:
            yield pd.DataFrame({key: name[0], "ts": passed})
        if last is not None:
            state.update((last,))

    return calls.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def capped_batches(messages: DataFrame, key: str, most: int = 50, gap_ms: int = 150) -> DataFrame:
    """Batches of at most ``most`` messages of a key, ended also by a gap; the last waits in state."""
    kind = messages.schema[key].dataType.simpleString()

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, 0)
        out = []
        for ts in in_order(batches)["ts"]:
            ms = int(ts.value // 1_000_000)
            if count and (count >= most or ms - last > gap_ms):
                out.append(count)
                count = 0
            count, last = count + 1, ms
        state.update((count, last))
        if out:
            yield pd.DataFrame({key: name[0], "messages": out})

    return messages.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, messages long", "count long, last long", "append", GroupStateTimeout.NoTimeout)


def stale_runs(runs: DataFrame, now: str, minutes: int = 5) -> DataFrame:
    """Running runs without activity for some minutes, or without any."""
    old = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last_activity")) > minutes * 60
    return runs.where("status = 'running'").where(F.col("last_activity").isNull() | old)


def changed_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """added, modified and deleted files between two listings (path, modified, size): what a file stream can't report."""
    return sync.changes(before, after, "path", "modified", "size").where("change != 'same'")


def upserting(path: str, key: str, values: tuple[str, ...]):
    """A foreachBatch function that keeps totals by key as Parquet: the last version plus the batch, a version each."""

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(*(F.sum(v).alias(v) for v in values))
        if number:
            new = spark.read.parquet(f"{path}/v{number - 1}").unionByName(new).groupBy(key).agg(*(F.sum(v).alias(v) for v in values))
        new.write.mode("overwrite").parquet(f"{path}/v{number}")  # a repeated batch writes the same version again

    return save


def started(spark: SparkSession, writer: DataStreamWriter, parts: int) -> StreamingQuery:
    """A stream whose state is dealt over ``parts`` tasks; it takes the settings that hold when it starts."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        return writer.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def drained(stream: DataFrame, folder: str, mode: str = "append", by_turns: bool = False, parts: int | None = None) -> DataFrame:
    """What a stream gives for all that is there now, as a table below ``folder``.

    A batch is written under its number, so a repeated one replaces itself; in complete mode the last batch is all.
    ``by_turns`` is for sources written in Python that give a part of what is there at a time: Spark asks those once
    where it is to take what is available now, and would end with the first part. ``parts`` is the number of tasks over
    which state is dealt, where keys are few: each batch loads and saves all of them, as many as a shuffle's by default.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{'batch=0' if mode == 'complete' else f'batch={number}'}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/state")
    writer = writer.trigger(processingTime="0 seconds") if by_turns else writer.trigger(availableNow=True)
    running = started(stream.sparkSession, writer, parts) if parts else writer.start()
    if by_turns:
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    else:
        running.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows").drop("batch")


def connection_events(events: DataFrame) -> DataFrame:
    """Per connection kind: opened, closed, failed, and the mean duration of all closings; ``ordered.health`` keeps the last 500.

    ``events``: kind, type (open or close), reason, ts, ms. A batch or a stream in complete mode.
    """
    closing = F.col("type") == "close"
    return events.groupBy("kind").agg(F.count_if(~closing).alias("opened"), F.count_if(closing).alias("closed"), F.count_if(closing & (F.col("reason") == "error")).alias("failed"), F.avg(F.when(closing, F.col("ms"))).alias("mean_ms"))


def vendor_lines(lines: DataFrame) -> DataFrame:
    """run, type, tool, input, output of JSON lines (run, text) of a vendor whose usage lies in an item or at the top; others pass as text."""
    at = lambda p: F.get_json_object("text", p)
    number = lambda *ps: F.coalesce(*(at(p).cast("bigint") for p in ps), F.lit(0).cast("bigint"))
    kind = F.coalesce(at("$.item.type"), at("$.type"), F.lit("text"))
    kind = F.when(kind.isin("command_execution", "function_call"), "tool_use").when(kind.isin("command_output", "function_call_output"), "tool_result").when(kind.isin("agent_message", "message"), "message").when(kind.isin("turn.completed", "usage"), "usage").otherwise(kind)
    return lines.select("run", kind.alias("type"), F.coalesce(at("$.item.name"), at("$.item.command")).alias("tool"), number("$.usage.input_tokens", "$.usage.prompt_tokens").alias("input"), number("$.usage.output_tokens", "$.usage.completion_tokens").alias("output"))
