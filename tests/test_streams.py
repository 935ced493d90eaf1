import json

from pyspark.sql import functions as F

from tarnworks.streaming import streams


def write(path, rows):
    path.write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")


def run(query, name, mode, tmp_path):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)


EVENTS = [{"ts": f"2026-01-01T00:{m:02d}:{s:02d}.000Z", "run": f"r{m % 2}", "type": t, "tool": "x", "input": m, "output": 1} for m in range(6) for s, t in ((0, "tool_use"), (10, "error"))]


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "a.json", EVENTS[:7])
    write(source / "b.json", EVENTS[7:])
    run(streams.run_totals(streams.event_stream(spark, str(source), files=1)), "totals", "complete", tmp_path)
    batch = streams.run_totals(spark.read.schema(streams.EVENT_SCHEMA).json(str(source)).where("ts is not null"))
    assert sorted(spark.table("totals").collect()) == sorted(batch.collect())
    assert {r.run: (r.tool_calls, r.failures) for r in batch.collect()} == {"r0": (3, 3), "r1": (3, 3)}


def test_windows_and_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "a.json", EVENTS)
    run(streams.usage_windows(streams.event_stream(spark, str(source)), "2 minutes"), "windows", "complete", tmp_path)
    assert spark.table("windows").agg(F.sum("events")).first()[0] == len(EVENTS)
    messages = spark.read.schema(streams.EVENT_SCHEMA).json(str(source)).where("ts is not null")
    assert streams.message_batches(messages, "30 seconds").count() == 12


def test_ring_buffer_and_limits(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "a.json", EVENTS)
    events = streams.event_stream(spark, str(source))
    run(streams.ring_buffer(events, "run", "input", size=4), "ring", "update", tmp_path)
    assert {r.run: (r.peak, r.held) for r in spark.table("ring").collect()} == {"r0": (4.0, 4), "r1": (5.0, 4)}
    run(streams.rate_limited(events, "run", 60_000), "limited", "append", tmp_path)
    assert spark.table("limited").count() == 6
    run(streams.capped_batches(events, "run", most=2, gap_ms=3_600_000), "capped", "append", tmp_path)
    assert {(r.run, r.messages) for r in spark.table("capped").collect()} == {("r0", 2), ("r1", 2)}


def test_upserts_and_changes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "a.json", EVENTS[:7])
    write(source / "b.json", EVENTS[7:])
    save = streams.upserting(str(tmp_path / "out"), "run", ("input", "output"))
    streams.event_stream(spark, str(source), files=1).writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    last = max(p.name for p in (tmp_path / "out").iterdir())
    assert {r.run: r.input for r in spark.read.parquet(str(tmp_path / "out" / last)).collect()} == {"r0": 12, "r1": 18}
    before = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, modified int, size int")
    after = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, modified int, size int")
    assert {r.path: r.change for r in streams.changed_runs(before, after).collect()} == {"b": "modified", "c": "deleted", "d": "added"}
    runs = spark.createDataFrame([("x", "running", "2026-01-01 00:00:00"), ("y", "running", None), ("z", "done", None), ("w", "running", "2026-01-01 00:09:00")], "id string, status string, t string").withColumn("last_activity", F.col("t").cast("timestamp"))
    assert {r.id for r in streams.stale_runs(runs, "2026-01-01 00:10:00").collect()} == {"x", "y"}
