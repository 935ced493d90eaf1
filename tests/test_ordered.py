"""Streams with timers give what one pass over all rows in order gives."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnworks.streaming import ordered, streams

FAR = pd.Timestamp("2026-06-01")
START = pd.Timestamp("2026-01-01")


def fed(spark, tmp_path, rows, columns, files):
    """A stream of ``rows`` (ms, ...) in so many files, one a micro-batch, and a last row that moves the watermark on."""
    source = tmp_path / "in"
    source.mkdir()
    frame = pd.DataFrame(rows, columns=["ts", *columns])
    frame["ts"] = START + pd.to_timedelta(frame["ts"], unit="ms")
    last = pd.DataFrame([[FAR, *(None if frame[c].dtype == object and c == "id" else "end" if frame[c].dtype == object else 0.0 for c in columns)]], columns=frame.columns)
    parts = [frame.iloc[len(frame) * k // files : len(frame) * (k + 1) // files] for k in range(files)]
    for k, part in enumerate([*parts, last]):  # taken in order of their times
        part.to_json(source / f"{k:03}.json", orient="records", lines=True, date_format="iso", date_unit="ms")
        os.utime(source / f"{k:03}.json", (1_700_000_000 + 10 * k,) * 2)
    kinds = ", ".join(f"{c} {'string' if frame[c].dtype == object else 'double'}" for c in columns)
    return spark.readStream.schema(f"ts timestamp, {kinds}").option("maxFilesPerTrigger", 1).json(str(source))


def given(spark, tmp_path, stream):
    return [r.asDict() for r in streams.drained(stream, f"file://{tmp_path}/out").collect()]


def test_throttle_with_caps_gaps_and_timers(spark, tmp_path):
    rng, rows, t = random.Random(4), [], 0
    for k in range(600):
        t += rng.choice([10, 30, 249, 250, 251, 900])
        rows.append((t, rng.choice("aabbc"), f"m{k}"))
    expected = []
    for key, delay in (("a", 250), ("b", 40)):
        batch = []
        for ms in [r[0] for r in rows if r[1] == key] + [10**12]:
            if batch and ms - batch[-1] >= delay:
                expected.append((key, len(batch), batch[0], batch[-1] + delay, "gap"))
                batch = []
            batch.append(ms)
            if len(batch) == 5:
                expected.append((key, 5, batch[0], ms, "full"))
                batch = []
    for k in range(0, 590, 10):  # files hold rows out of order, by less than the watermark allows
        rows[k : k + 10] = rng.sample(rows[k : k + 10], 10)
    stream = fed(spark, tmp_path, rows, ["type", "id"], 4)
    got = given(spark, tmp_path, ordered.throttled(stream, delays={"b": 40}, most=5, types=("a", "b", "end"), late="30 seconds"))
    zero = int(START.value // 1_000_000)
    assert sorted((r["type"], r["messages"], r["first_ms"] - zero, r["flushed_ms"] - zero, r["cause"]) for r in got if r["type"] in "ab") == sorted(expected)
    assert [(r["messages"], r["cause"]) for r in got if r["type"] not in "ab"] == [(1, "through")] * sum(r[1] == "c" for r in rows)


@pytest.fixture(scope="module")
def many():
    """25,000 samples of one key, more than an Arrow batch holds, in no order."""
    rng = random.Random(7)
    rows = [(1000 * k, "k", float(rng.randrange(1000)), f"c{k:05}") for k in range(25_000)]
    return rng.sample(rows, len(rows))


def test_one_key_of_many_rows_in_one_batch(spark, tmp_path, many):
    stream = fed(spark, tmp_path, many, ["key", "value", "id"], 1)
    (got,) = [r for r in given(spark, tmp_path, ordered.ring_metrics(stream, late="10 hours")) if r["key"] == "k"]
    rows = spark.createDataFrame([r[:3] for r in many], "ms long, key string, value double")
    newest = rows.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ms")))).where("rn <= 360")
    expected = newest.agg(F.max("value"), F.avg("value"), F.count("*")).first()
    assert (got["peak"], got["held"]) == (expected[0], expected[2]) and abs(got["mean"] - expected[1]) < 1e-9


def test_every_spaced_call_passes(spark, tmp_path, many):
    stream = fed(spark, tmp_path, many, ["key", "value", "id"], 1)
    got = given(spark, tmp_path, ordered.rate_limited(stream.select("ts", "key", "id"), 500, late="10 hours"))
    assert sorted(r["id"] for r in got if r["key"] == "k") == sorted(r[3] for r in many)


def test_rows_within_a_micro_batch_are_ordered(spark, tmp_path, many):
    """The functions without timers: one micro-batch of several Arrow batches."""
    stream = fed(spark, tmp_path, many, ["key", "value", "id"], 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = given(spark, tmp_path, streams.rate_limited(stream, "key", 500))
        assert sum(r["key"] == "k" for r in got) == len(many)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rate_limit_over_micro_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted((rng.randrange(40_000), rng.choice("xyz"), f"c{k}") for k in range(300))
    expected, last = [], {}
    for ms, key, call in sorted(rows, key=lambda r: (r[0], r[2])):
        if key not in last or ms - last[key] >= 500:
            last[key] = ms
            expected.append(call)
    got = given(spark, tmp_path, ordered.rate_limited(fed(spark, tmp_path, rows, ["key", "id"], 3), 500, late="1 second"))
    assert sorted(r["id"] for r in got if r["key"] != "end") == sorted(expected)


def test_many_keys_of_a_rate_limit_share_state_and_timers(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted((rng.randrange(20_000), f"k{k % 400}", f"c{k}") for k in range(2_000))
    expected, last = [], {}
    for ms, key, call in sorted(rows, key=lambda r: (r[0], r[2])):
        if key not in last or ms - last[key] >= 5_000:
            last[key] = ms
            expected.append((key, call))
    calls, got = ordered.rate_limited(fed(spark, tmp_path, rows, ["key", "id"], 2), 5_000, late="30 seconds"), []
    save = lambda batch, _: got.extend((r.key, r.id) for r in batch.collect() if r.key != "end")
    query = calls.writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(got) == sorted(expected)
    timers = [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress]
    assert 0 < timers[0] <= 256 < len(last)


def test_rows_bring_only_what_is_folded(spark, tmp_path):
    stream = fed(spark, tmp_path, [(k, "a", f"m{k}", "wide") for k in range(4)], ["type", "id", "text"], 1)
    plan = ordered.throttled(stream)._jdf.queryExecution().analyzed()
    taken = [c.split("#")[0] for c in plan.children().apply(0).output().mkString(",").split(",")]
    assert set(taken) == {"type", "ts", "ms"}


def test_idle_keys_leave_their_state(spark, tmp_path):
    rows = [(k * 10, f"k{k % 5}", float(k), "x") for k in range(50)]
    stream = fed(spark, tmp_path, rows, ["key", "value", "id"], 1)
    ring = ordered.ring_metrics(stream, size=4, idle_ms=60_000)
    query = ring.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    kept = spark.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / "check")).select("key.key").distinct()
    assert {r.key for r in kept.collect()} <= {"end"}
    (got,) = [p["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) for p in query.recentProgress[:1]]
    assert got >= 0


def test_health_keeps_its_last_closings(spark, tmp_path):
    rng, rows, live, t = random.Random(2), [], [], 0
    for k in range(900):
        t += rng.choice([20, 50, 400])
        if live and rng.random() < 0.5:
            rows.append((t, "s", "close", live.pop(rng.randrange(len(live))), rng.choice(["close", "error", "prune", "write_fail"])))
        else:
            live.append(f"c{k}")
            rows.append((t, "s", "open", f"c{k}", "-"))
    rows.append((t + 1, "s", "close", "unknown", "close"))
    opened, closings, peak, now = {}, [], 0, 0
    for ms, _, kind, i, reason in rows:
        if kind == "open":
            opened[i] = ms
            now += 1
            peak = max(peak, now)
        elif i in opened:
            closings.append((ms, ms - opened[i], reason in ordered.BY_EVENT))
            now -= 1
    kept, end = closings[-100:], rows[-1][0]
    took = [n for ms, n, _ in kept if ms >= end - 300_000]
    stream = fed(spark, tmp_path, rows, ["key", "type", "id", "reason"], 3)
    got = given(spark, tmp_path, ordered.health(stream, most=100, late="1 second"))
    last = max((r for r in got if r["key"] == "s"), key=lambda r: r["ms"])
    assert (last["active"], last["peak"], last["opened"], last["closed"]) == (now, peak, len(opened), len(closings))
    assert last["recent"] == sum(ms >= end - 60_000 for ms, *_ in kept) and last["mean_ms"] == int(sum(took) / len(took) + 0.5)
    assert last["rate"] == int(sum(c[2] for c in closings) / len(closings) * 1000 + 0.5) / 1000 and last["health"] == "unhealthy"


class Held(dict):
    """Map state, or list state under one key, without a server."""

    updateValue, removeKey, getValue = dict.__setitem__, dict.pop, dict.__getitem__
    put = lambda self, rows: self.__setitem__(0, rows)

    def get(self):
        return iter(self[0] if self else ())


class Handle:
    def __init__(self):
        self.timers = []
        self.getMapState = self.getListState = lambda *_: Held()
        self.registerTimer = self.timers.append


class Clock:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = lambda: now


def test_a_timer_holds_a_slice_of_a_key_at_a_time(monkeypatch):
    held, plain = [], ordered.Sorted
    monkeypatch.setattr(ordered, "Sorted", lambda table, end: held.append(0 if table is None else table.num_rows) or plain(table, end))
    processor, handle, width = ordered.RateLimit(1), Handle(), ordered.InOrder.slice_ms
    processor.init(handle)
    ms = [k * width // 3_000 for k in range(60_000)]  # 20 slices
    random.Random(3).shuffle(ms)
    frames = [pd.DataFrame({"key": "k", "ms": part, "id": [f"c{v}" for v in part]}) for part in (ms[:25_000], ms[25_000:50_000], ms[50_000:])]
    list(processor.handleInputRows(("k",), iter(frames), Clock(0)))
    assert min(handle.timers) == 0
    got = []
    for now in (7 * width + 5, 40 * width):  # what is later than the first timer waits for the second
        got += [v for frame in processor.handleExpiredTimer(("k",), Clock(now), None) for v in frame["ms"]]
        assert got == sorted(v for v in ms if v <= now)
    assert max(held) <= 3_100 and not processor.waiting and 7 * width + 5 < handle.timers[-1] < 8 * width
