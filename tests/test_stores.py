import json
import os
import threading
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from tarnworks.sources import formats
from tarnworks.sources.formats import Registry
from tarnworks.sources.store import DELETED, Conflict, Store

RECORD = "id string, status string, n bigint, tags array<string>, m map<string,bigint>, s struct<a:int,b:string>, modified_ms bigint"


@pytest.fixture(scope="module")
def registry(spark):
    return Registry(spark)


# -- sources


def test_records_round_trip_and_broken_files(registry, spark, tmp_path):
    rows = spark.sql("SELECT concat('r', id) id, if(id % 2 = 0, 'done', null) status, 9007199254740993 + id n, array('a', 'é') tags, map('k', id) m, named_struct('a', 1, 'b', 'x') s FROM range(40)")
    rows.repartition(4).write.format("tarnworks_records").mode("append").save(str(tmp_path))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")] and len(list(tmp_path.iterdir())) == 40
    assert json.loads((tmp_path / "r3.json").read_text()) == {"id": "r3", "m": {"k": 3}, "n": 9007199254740996, "s": {"a": 1, "b": "x"}, "tags": ["a", "é"]}
    (tmp_path / "r1.json").write_text("{broken")
    (tmp_path / "r2.json").write_text("[1]")
    (tmp_path / "r4.json").write_text('{"status": 5, "n": "text", "tags": 1, "m": [], "s": {"a": 1e300}}')
    (tmp_path / "r5.json.gz").write_bytes(b"\x1f\x8bnot gzip")
    (tmp_path / ".hidden.json").write_text("{}")
    got = {r.id: r for r in registry.read("tarnworks_records", RECORD, path=str(tmp_path), bytesPerPartition=1000).collect()}
    assert len(got) == 38 and "r1" not in got and "r2" not in got
    assert got["r6"].n == 9007199254740999 and got["r6"].tags == ["a", "é"] and got["r6"].m == {"k": 6} and got["r6"].s.b == "x" and got["r7"].status is None
    assert (got["r4"].status, got["r4"].n, got["r4"].tags, got["r4"].m, got["r4"].s.a) == ("5", None, None, None, None)
    assert registry.read("tarnworks_records", RECORD, path=str(tmp_path / "none")).count() == 0


def test_filters_prune_files_before_they_are_opened(registry, spark, tmp_path):
    for k in range(30):
        (tmp_path / f"r{k:02}.json").write_text(json.dumps({"n": k}))
    (tmp_path / "r05.json").chmod(0)
    reader = formats.RecordReader({"path": str(tmp_path)}, None)
    left = list(reader.pushFilters([formats.StringStartsWith(("id",), "r0"), formats.LessThan(("id",), "r04"), formats.EqualTo(("n",), 3)]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and [f.path for p in reader.partitions() for f in p.files] == [f"r0{k}.json" for k in range(4)]
    rows = registry.read("tarnworks_records", "id string, n bigint", path=str(tmp_path)).where("id like 'r0%' and id < 'r04' and n > 1")
    assert sorted(r.n for r in rows.collect()) == [2, 3]
    assert "StartsWith" not in rows._jdf.queryExecution().executedPlan().toString()
    assert registry.read("tarnworks_records", "id string, n bigint", path=str(tmp_path)).where("id in ('r07', 'r08', 'zz')").count() == 2


def test_files_are_packed_by_size():
    files = [formats.File(f"f{k}", size, 0) for k, size in enumerate([100, 50, 60, 500, 1])]
    assert [[f.path for f in p.files] for p in formats.packed(files, 100 + formats.OPEN_COST)] == [["f0"], ["f1", "f2"], ["f3"], ["f4"]]
    assert formats.packed([], 10) == []


def test_an_aborted_write_leaves_no_file(registry, spark, tmp_path):
    (tmp_path / "old.json").write_text('{"n": 1}')
    rows = spark.sql("SELECT if(id = 7, 'a/b', concat('r', id)) id, id n FROM range(0, 10, 1, 5)")
    with pytest.raises(Exception, match="not a file name"):
        rows.write.format("tarnworks_records").mode("append").save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["old.json"]


def test_a_repeated_task_writes_once(tmp_path):
    class Row:
        def asDict(self, recursive):
            return {"id": "x", "n": 1}

    writer = formats.RecordWriter({"path": str(tmp_path)}, False)
    first, second = writer.write(iter([Row()])), writer.write(iter([Row()]))
    writer.commit([second, None])
    assert [p.name for p in tmp_path.iterdir()] == ["x.json"] and first.names != second.names


def test_overwrite_leaves_only_new_records(registry, spark, tmp_path):
    spark.sql("SELECT 'a' id, 1 n UNION ALL SELECT 'b', 1").write.format("tarnworks_records").mode("append").save(str(tmp_path))
    spark.sql("SELECT 'b' id, 2 n UNION ALL SELECT 'c', 2").write.format("tarnworks_records").mode("overwrite").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b.json", "c.json"]


def test_stream_takes_new_files_once(registry, spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def drain():
        rows = registry.read_stream("tarnworks_records", "id string, n bigint", path=str(source), maxFilesPerTrigger=3)
        rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted(r.n for r in spark.read.parquet(str(out)).collect())

    for k in range(8):
        (source / f"{k}.json").write_text(json.dumps({"n": k}))
    assert drain() == list(range(8))
    (source / "0b.json").write_text(json.dumps({"n": 8}))
    assert drain() == list(range(9))


def test_inventory_source(registry, spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("x\ny")
    (tmp_path / "b.md").write_text("x\n")
    (tmp_path / "c").write_bytes(b"a\0\n")
    (tmp_path / "d.py").write_bytes(b"")
    got = {r.path: (r.size, r.lines, r.language) for r in registry.read("tarnworks_inventory", path=str(tmp_path)).collect()}
    assert got == {"src/a.ts": (3, 2, "TypeScript"), "b.md": (2, 1, "Markdown"), "c": (3, 0, "Other"), "d.py": (0, 0, "Python")}
    assert registry.read("tarnworks_inventory", path=str(tmp_path)).where("language = 'Python' or size = 0").count() == 1
    assert registry.read("tarnworks_inventory", path=str(tmp_path)).where("language = 'Markdown' and size < 3").count() == 1


class Counter(DataSource):
    needs, secret, about = ("upto", "key"), ("key",), "numbers"

    @classmethod
    def name(cls):
        return "tests_counter"

    def schema(self):
        return "n int"

    def reader(self, schema):
        return CounterReader(int(self.options["upto"]))


class CounterReader(DataSourceReader):
    def __init__(self, upto):
        self.upto = upto

    def read(self, partition):
        return ((k,) for k in range(self.upto))


def test_registry(spark):
    registry = Registry(spark)
    registry.add(Counter)
    with pytest.raises(ValueError, match="already"):
        registry.add(Counter)
    with pytest.raises(ValueError, match="needs key"):
        registry.read("tests_counter", upto=3)
    with pytest.raises(ValueError, match="built in"):
        registry.remove("tarnworks_records")
    assert registry.read("tests_counter", upto=3, key="k").count() == 3
    assert registry.shown("tests_counter", {"key": "abcdefghij", "apiKey": "short", "upto": 3}) == {"key": "abcd****ghij", "apiKey": "****", "upto": "3"}
    assert {r.name: (r.built_in, r.needs) for r in registry.table().collect()} == {"tarnworks_records": (True, ["path"]), "tarnworks_inventory": (True, ["path"]), "tests_counter": (False, ["upto", "key"])}
    registry.remove("tests_counter")
    with pytest.raises(ValueError, match="not registered"):
        registry.read("tests_counter", upto=3, key="k")
    with pytest.raises(ValueError, match="not registered"):
        registry.remove("tests_counter")


# -- store


def test_store_versions_and_touched_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    assert store.version() == 0 and store.snapshot() is None
    store.merge(spark.range(100).selectExpr("id", "'old' v", "map('k', timestamp'0001-01-01') more"), "load")
    store.merge(spark.sql("SELECT 5L id, 'new' v, map('k', timestamp'2020-01-01') more"), "one")
    store.merge(spark.range(0, 100, 2).select("id", F.lit(True).alias(DELETED)), "delete")
    assert store.snapshot(1).where("v = 'new'").count() == 0 and store.snapshot(1).count() == 100
    assert store.snapshot().count() == 50 and store.snapshot().where("id = 5").first().v == "new"
    assert [(r.note, r.touched) for r in store.history().orderBy("version").collect()] == [("", 0), ("load", 8), ("one", 1), ("delete", 8)]
    store.merge(spark.range(1, 100, 2).select("id", F.lit(True).alias(DELETED)))
    assert store.snapshot().count() == 0 and store.snapshot().columns == ["id", "v", "more"]
    store.merge(spark.sql("SELECT 1L id, 'x' v, 7 added"), "wider")
    assert store.snapshot().first().added == 7 and store.snapshot(1).columns == ["id", "v", "more"]
    for rows in (spark.sql("SELECT 1L id, 'a' v UNION ALL SELECT 1L, 'b'"), spark.sql("SELECT CAST(null AS bigint) id, 'a' v")):
        with pytest.raises(ValueError, match="null or repeated"):
            store.merge(rows)
    with pytest.raises(ValueError, match="key is id"):
        Store(spark, str(tmp_path), "other")
    assert store.vacuum(1) > 0 and store.snapshot().count() == 1


def test_whole_entries_bound_what_a_reader_opens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tarnworks.sources.store.WHOLE", 3)
    store = Store(spark, str(tmp_path), buckets=4)
    for k in range(7):
        store.merge(spark.sql(f"SELECT {k}L id, {k} n"))
    assert sorted(r.n for r in store.snapshot().collect()) == list(range(7))
    assert sorted(r.n for r in store.snapshot(4).collect()) == list(range(4))
    assert [bool(json.loads(Path(tmp_path, "log", f"{v:012}.json").read_text()).get("whole")) for v in range(8)] == [True, False, False, True, False, False, True, False]


def test_writers_of_other_buckets_need_no_second_attempt(spark, tmp_path):
    store, other = Store(spark, str(tmp_path), buckets=64), Store(spark, str(tmp_path), buckets=64)
    store.merge(spark.sql("SELECT 1L id, 0 n UNION ALL SELECT 2L, 0"))
    written = store._written

    def slow(*args):
        entry = written(*args)
        other.merge(spark.sql("SELECT 2L id, 5 n"))
        return entry

    store._written = slow
    store.merge(spark.sql("SELECT 1L id, 7 n"))
    assert store.retried == 0 and {r.id: r.n for r in store.snapshot().collect()} == {1: 7, 2: 5}


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    stores = [Store(spark, str(tmp_path), buckets=2) for _ in range(2)]
    stores[0].merge(spark.sql("SELECT 1L id, 0 n"))
    failed = []

    def count(store):
        try:
            for _ in range(4):
                store.transact(lambda now: now.withColumn("n", F.col("n") + 1), retries=50)
        except Exception as e:  # shown below
            failed.append(e)

    threads = [threading.Thread(target=count, args=(s,)) for s in stores]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and stores[0].snapshot().first().n == 8 and stores[0].version() == 9


def test_a_writer_that_is_always_late_gives_up(spark, tmp_path):
    store, other = Store(spark, str(tmp_path), buckets=1), Store(spark, str(tmp_path), buckets=1)
    store.merge(spark.sql("SELECT 1L id, 0 n"))

    def late(now):
        other.merge(spark.sql("SELECT 1L id, 9 n"))
        return now.withColumn("n", F.lit(1))

    with pytest.raises(Conflict):
        store.transact(late, retries=1)
    assert store.retried == 2 and store.snapshot().first().n == 9


def test_a_stream_by_turns_drains_all(registry, spark, tmp_path):
    from tarnworks.streaming import streams

    source = tmp_path / "in"
    source.mkdir()
    for k in range(8):
        (source / f"{k}.json").write_text(json.dumps({"n": k}))
    rows = registry.read_stream("tarnworks_records", "id string, n bigint", path=str(source), maxFilesPerTrigger=3)
    assert sorted(r.n for r in streams.drained(rows, str(tmp_path / "out"), by_turns=True).collect()) == list(range(8))
    total = rows.groupBy().agg(F.sum("n").alias("n"))
    assert [r.n for r in streams.drained(total, str(tmp_path / "sum"), "complete", by_turns=True).collect()] == [28]


def test_batches_of_a_stream_share_a_listing(tmp_path, monkeypatch):
    listings, plain = [], formats.listed
    monkeypatch.setattr(formats, "listed", lambda *a: listings.append(1) or plain(*a))
    monkeypatch.setattr(formats, "RELISTED", 1e9, raising=False)
    for k in range(40):
        (tmp_path / f"{k:02}.json").write_text("{}")
    stream = formats.FolderStream(formats.RecordReader({"path": str(tmp_path)}, None), 2)
    start, taken = stream.initialOffset(), []
    while (end := stream.latestOffset()) != start:
        taken += [f.path for p in stream.partitions(start, end) for f in p.files]
        start = end
    assert taken == [f.path for f in plain(str(tmp_path))] and len(taken) == 40
    assert len(listings) == 2  # of all files, and whether more have come
    (tmp_path / "more.json").write_text("{}")
    assert [f.path for p in stream.partitions(start, stream.latestOffset()) for f in p.files] == ["more.json"]
    again = formats.FolderStream(stream.reader, 2)  # a restart repeats a batch that it has not listed
    assert [f.path for p in again.partitions(start, end | {"path": "more.json", "modified": stream.seen[-1].modified}) for f in p.files] == ["more.json"]
    assert again.latestOffset()["path"] == "more.json"


def test_an_old_listing_is_made_anew_before_all_of_it_is_taken(tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "RELISTED", 0, raising=False)
    for k in range(4):
        (tmp_path / f"{k}.json").write_text("{}")
    os.utime(tmp_path / "3.json", ns=(2 << 60, 2 << 60))
    stream = formats.FolderStream(formats.RecordReader({"path": str(tmp_path)}, None), 1)
    assert stream.latestOffset()["path"] == "0.json"
    (tmp_path / "a.json").write_text("{}")  # comes before a file that was listed
    assert [stream.latestOffset()["path"] for _ in range(4)] == ["1.json", "2.json", "a.json", "3.json"]


def test_state_of_few_keys_is_dealt_over_few_tasks(registry, spark, tmp_path):
    from tarnworks.streaming import streams

    (tmp_path / "in").mkdir()
    for k in range(8):
        (tmp_path / f"in/{k}.json").write_text(json.dumps({"n": k}))
    rows = registry.read_stream("tarnworks_records", "id string, n bigint", path=str(tmp_path / "in"), maxFilesPerTrigger=3)
    total = rows.groupBy((F.col("n") % 3).alias("k")).agg(F.sum("n").alias("n"))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    out = streams.drained(total, str(tmp_path / "sum"), "complete", by_turns=True, parts=2)
    assert {(r.k, r.n) for r in out.collect()} == {(0, 9), (1, 12), (2, 7)}
    assert sorted(p.name for p in (tmp_path / "sum/state/state/0").iterdir() if p.name.isdigit()) == ["0", "1"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == held != "2"


def test_components_follow_all_lines_and_all_suppliers(spark, tmp_path):
    from tarnworks.plans import stores

    tables = {
        "orders": "SELECT * FROM VALUES (1L, 3L), (2L, 4L), (3L, 5L) t(o_orderkey, o_custkey)",
        "lineitem": "SELECT * FROM VALUES (1L, 9L, 1), (1L, 4L, 2), (2L, 3L, 7), (3L, 5L, 1) t(l_orderkey, l_suppkey, l_linenumber)",
        "supplier": "SELECT id AS s_suppkey, CAST(24 - id AS INT) AS s_nationkey FROM range(3, 10)",
        "part": "SELECT id AS p_partkey FROM range(41)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {tuple(r) for r in stores.cycle_components(spark, str(tmp_path)).select("component", "nodes", "edges").collect()}
    assert got == {(6, 4, 4), (10, 2, 2), (-40, 40, 40)}  # customer 3, supplier 4, customer 4, supplier 3; customer and supplier 5
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert {tuple(r) for r in con.execute(stores.SQL["cycle_components"]).fetchall()} == got
