"""State with timers: a key's rows in event order, however they arrive, and keys that leave when idle.

Rows wait in map state until the watermark passes them; a timer then takes those that are due, in order of time, and
folds them into the key's state. What is due later (a batch that waits for its gap, a key to forget) is a timer too.
So results are those of one pass over all rows in order, whatever the micro-batches and Arrow batches, and a key
without rows or open state holds none. Rows later than the watermark allows are dropped by Spark.

State lies in RocksDB; ``with_state`` sets the session's provider.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class InOrder(StatefulProcessor):
    """Folds a key's rows (ms, and the columns of ``row``) in order of time; subclasses say how.

    ``state`` is the schema of what a key keeps, ``out`` that of the rows given; both as in ``fold`` and ``due``.
    Rows wait as Arrow tables, each under the slice of time that its first row lies in. Many rows of a key are cut at the
    slices, so that a timer holds those of one slice at a time, however many are due.
    """

    row, state, out = "", "", ""
    slice_ms = 6 * 3_600_000
    #: Rows of a key that are put by together, and from how many on they are cut into slices.
    together, many = 200_000, 20_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long, part string", "rows binary")
        self.kept = handle.getListState("kept", self.state)
        self.columns = ["ms", *(c.split()[0] for c in self.row.split(", ") if c)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, held, n = None, [], 0
        for batch in rows:
            held.append(pa.Table.from_pandas(batch[self.columns], preserve_index=False))
            n += len(batch)
            least = int(batch["ms"].min())
            first = least if first is None else min(first, least)
            if n >= self.together:
                self._put_by(held)
                held, n = [], 0
        if held:
            self._put_by(held)
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def _put_by(self, tables: list[pa.Table]) -> None:
        rows = joined(tables)
        ms = rows["ms"].to_numpy()
        starts = [0]
        if len(ms) >= self.many:
            order = np.argsort(ms, kind="stable")
            rows, ms = rows.take(order), ms[order]
            starts += (np.flatnonzero(np.diff(ms // self.slice_ms)) + 1).tolist()
        for start, end in zip(starts, [*starts[1:], len(ms)]):
            part = rows.slice(start, end - start)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_table(part)
            self.waiting.updateValue((int(ms[start:end].min()) // self.slice_ms, uuid.uuid4().hex), (sink.getvalue().to_pybytes(),))

    def _due_rows(self, now: int, later: list[pa.Table]) -> Iterator[tuple]:
        """Rows up to ``now`` in order, a slice at a time; what is later ends in ``later``."""
        parts = {}
        for at, name in self.waiting.keys():
            parts.setdefault(at, []).append(name)
        ahead = None  # rows of parts that reach beyond their slice
        for at in sorted(k for k in parts if k * self.slice_ms <= now):
            yield from (given := Sorted(ahead, at * self.slice_ms - 1))
            ahead, tables = given.rest, [] if given.rest is None else [given.rest]
            for name in parts[at]:
                tables.append(pa.ipc.open_stream(self.waiting.getValue((at, name))[0]).read_all())
                self.waiting.removeKey((at, name))
            yield from (given := Sorted(joined(tables), min(now, (at + 1) * self.slice_ms - 1)))
            ahead = given.rest
        yield from (given := Sorted(ahead, now))
        if given.rest is not None:
            later.append(given.rest)
        self.next_slice = min((k * self.slice_ms for k in parts if k * self.slice_ms > now), default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        had = [tuple(r) for r in self.kept.get()]
        kept, later = list(had), []
        names = [c.split()[0] for c in self.out.split(", ")]
        for given in batched(self.fold(key[0], self._due_rows(now, later), kept, now), 10_000):
            yield pd.DataFrame(given, columns=names)
        if kept:
            self.kept.put(kept)
        elif had:
            self.kept.clear()
        due = [t for t in (self.next_slice, self.due(kept)) if t is not None]
        for rows in later:
            self._put_by([rows])
            due.append(int(rows["ms"].to_numpy().min()))
        if due:
            self.handle.registerTimer(int(max(min(due), now + 1)))

    def fold(self, key, rows: Iterator[tuple], kept: list[tuple], now: int) -> Iterator[tuple]:
        """Rows to give after all of ``rows`` and once the time is ``now``; ``kept`` is changed to what to keep."""
        raise NotImplementedError

    def due(self, kept: list[tuple]) -> int | None:
        """When the key needs a timer besides its rows."""
        return None


def joined(tables: list[pa.Table]) -> pa.Table:
    """One table; a column that has only nulls in some takes its type from the others."""
    return pa.concat_tables(tables, promote_options="permissive").combine_chunks()


class Sorted:
    """Rows of ``table`` up to ``end`` as tuples, by ms and then by the others as texts; ``rest`` is what is later."""

    def __init__(self, table: pa.Table | None, end: int):
        self.rows, self.rest = table, None
        if table is not None and table.num_rows:
            soon = pc.less_equal(table["ms"], end)
            self.rows, rest = table.filter(soon), table.filter(pc.invert(soon))
            self.rest = rest if rest.num_rows else None

    def __iter__(self) -> Iterator[tuple]:
        if self.rows is None or not self.rows.num_rows:
            return
        text = lambda c: c.fill_null("None") if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else pa.array(map(str, c.to_pylist()), pa.string())
        by = [("ms", self.rows["ms"]), *((f"c{k}", text(c)) for k, c in enumerate(self.rows.columns[1:]))]
        order = pc.sort_indices(pa.table(dict(by)), [(name, "ascending") for name, _ in by])
        yield from zip(*(c.to_pylist() for c in self.rows.take(order).columns))


def applied(rows: DataFrame, key: str, processor: InOrder, late: str) -> DataFrame:
    with_state(rows.sparkSession)
    # each row crosses to Python by itself, so only with what is folded
    named = dict.fromkeys([key, *(c.split()[0] for c in processor.row.split(", ") if c)])
    timed = rows.withWatermark("ts", late).select("ts", *named, F.unix_millis("ts").alias("ms"))
    return timed.groupBy(key).transformWithStateInPandas(processor, processor.out, "Append", "EventTime")


class Throttle(InOrder):
    """Messages of a type held back until none came for its delay, or until ``most`` wait."""

    state = "ms long, first long, count long"
    out = "type string, messages long, first_ms long, last_ms long, flushed_ms long, cause string"

    def __init__(self, delay_ms: int, delays: dict[str, int], most: int):
        self.delay_ms, self.delays, self.most = delay_ms, delays, most

    def fold(self, key, rows, kept, now):
        self.delay = self.delays.get(key, self.delay_ms)
        last, first, count = kept[0] if kept else (0, 0, 0)
        for (ms,) in rows:
            if count and ms - last >= self.delay:  # the timer came first
                yield key, count, first, last, last + self.delay, "gap"
                count = 0
            first, last, count = (first if count else ms), ms, count + 1
            if count >= self.most:
                yield key, count, first, last, last, "full"
                count = 0
        if count and last + self.delay <= now:
            yield key, count, first, last, last + self.delay, "gap"
            count = 0
        kept[:] = [(last, first, count)] if count else []

    def due(self, kept):
        return kept[0][0] + self.delay if kept else None


def throttled(messages: DataFrame, delay_ms: int = 250, delays: dict[str, int] | None = None, most: int = 20, types: tuple[str, ...] | None = None, late: str = "10 seconds") -> DataFrame:
    """Batches of messages (ts, type, id) of each type, with why they ended; with ``types``, others pass one by one.

    The delay starts anew with each message; a type may have a delay of its own.
    """
    held = messages if types is None else messages.where(F.col("type").isin(*types))
    out = applied(held, "type", Throttle(delay_ms, delays or {}, most), late)
    if types is None:
        return out
    ms = F.unix_millis("ts")
    through = messages.where(~F.coalesce(F.col("type").isin(*types), F.lit(False)))
    return out.unionByName(through.select("type", F.lit(1).cast("long").alias("messages"), ms.alias("first_ms"), ms.alias("last_ms"), ms.alias("flushed_ms"), F.lit("through").alias("cause")))


class RateLimit(InOrder):
    """Calls of the keys of a bucket, which wait together: state and timers of a key each would cost more than its calls."""

    row, state, out = "key string, id string", "key string, ms long", "key string, ms long, id string"

    def __init__(self, least_ms: int):
        self.least_ms = least_ms

    def fold(self, bucket, rows, kept, now):
        passed = dict(kept)
        for ms, key, call in rows:
            last = passed.get(key)
            if last is None or ms - last >= self.least_ms:
                passed[key] = ms
                yield key, ms, call
        # once its pause is over, a key's next call passes whatever came before
        kept[:] = [(key, last) for key, last in passed.items() if last + self.least_ms > now]

    def due(self, kept):
        return min(last for _, last in kept) + self.least_ms if kept else None


def rate_limited(calls: DataFrame, least_ms: int = 500, late: str = "10 seconds", buckets: int = 256) -> DataFrame:
    """Calls (ts, key, id) that come at least ``least_ms`` after the last one of their key that passed.

    Keys are dealt over ``buckets``, so that many keys of a few calls take no more state and timers than a few keys do.
    """
    dealt = calls.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return applied(dealt, "bucket", RateLimit(least_ms), late)


class Ring(InOrder):
    """The last samples of a key; a key without samples for ``idle_ms`` is forgotten."""

    row, state = "value double", "ms long, value double"
    out = "key string, ms long, peak double, mean double, held long"

    def __init__(self, size: int, idle_ms: int):
        self.size, self.idle_ms = size, idle_ms

    def fold(self, key, rows, kept, now):
        held, news = deque(kept, self.size), False
        for row in rows:
            if held and row[0] - held[-1][0] > self.idle_ms:
                held.clear()
            held.append(row)
            news = True
        if news:
            values = [v for _, v in held]
            yield key, held[-1][0], max(values), sum(values) / len(values), len(values)
        kept[:] = [] if held and held[-1][0] + self.idle_ms < now else held

    def due(self, kept):
        return kept[-1][0] + self.idle_ms + 1 if kept else None


def ring_metrics(samples: DataFrame, size: int = 360, idle_ms: int = 86_400_000, late: str = "10 seconds") -> DataFrame:
    """Peak, mean and count of the last ``size`` samples (ts, key, value) of a key, each time that some become due."""
    return applied(samples.withColumn("value", F.col("value").cast("double")), "key", Ring(size, idle_ms), late)


class Health(InOrder):
    """Connections of a server: what is open since when, counters, and the last ``most`` closings."""

    row = "type string, id string, reason string"
    state = "kind string, id string, ms long, n long"
    out = "key string, ms long, active long, peak long, opened long, closed long, recent long, mean_ms long, rate double, health string"

    def __init__(self, most: int, recent_ms: int, mean_ms: int):
        self.most, self.recent_ms, self.mean_ms = most, recent_ms, mean_ms

    def fold(self, key, rows, kept, now):
        live = {i: ms for kind, i, ms, _ in kept if kind == "open"}
        closings = deque(((ms, n) for kind, _, ms, n in kept if kind == "closing"), self.most)
        counts = {i: n for kind, i, _, n in kept if kind == "count"}
        opened, closed, peak, told = (counts.get(c, 0) for c in ("opened", "closed", "peak", "by_event"))
        at = None
        for at, kind, i, reason in rows:
            if kind == "open":
                live[i] = at
                opened += 1
                peak = max(peak, len(live))
            elif i in live:  # an unknown or closed connection doesn't close again
                closings.append((at, at - live.pop(i)))
                closed += 1
                told += reason in BY_EVENT
        if at is None:
            return
        recent = sum(ms >= at - self.recent_ms for ms, _ in closings)
        took = [n for ms, n in closings if ms >= at - self.mean_ms]
        rate = told / closed if closed else 1.0
        health = "unhealthy" if rate < 0.7 or recent > 50 else "degraded" if rate < 0.9 or recent > 20 else "healthy"
        mean = int(sum(took) / len(took) + 0.5) if took else 0
        yield key, at, len(live), peak, opened, closed, recent, mean, int(rate * 1000 + 0.5) / 1000, health
        counts = {"opened": opened, "closed": closed, "peak": peak, "by_event": told}
        kept[:] = [*(("open", i, ms, 0) for i, ms in live.items()), *(("closing", "", ms, n) for ms, n in closings), *(("count", i, 0, n) for i, n in counts.items())]


#: Reasons of closing that a server is told of, rather than finds out.
BY_EVENT = ("close", "error", "end", "shutdown")


def health(events: DataFrame, most: int = 500, recent_ms: int = 60_000, mean_ms: int = 300_000, late: str = "10 seconds") -> DataFrame:
    """A snapshot of each server's connections (ts, key, type open or close, id, reason), each time that events become due."""
    return applied(events, "key", Health(most, recent_ms, mean_ms), late)
