import gzip
import json

import pytest
from pyspark.sql import functions as F

from tarnworks.sources import readers, writers


@pytest.fixture
def run_folder(tmp_path):
    def run(k, **more):
        return {"id": f"r{k}", "taskId": f"t{k % 2}", "startedAt": f"2026-01-0{k + 1}T00:00:00Z", "status": "completed", "tokenUsage": {"input": 100 * k, "output": 10 * k}, **more}

    (tmp_path / "r1.json").write_text(json.dumps(run(1)))
    with gzip.open(tmp_path / "r1.json.gz", "wt") as f:
        f.write(json.dumps(run(1, status="old")))
    with gzip.open(tmp_path / "r2.json.gz", "wt") as f:
        f.write(json.dumps(run(2, tokenUsage={"input": 5, "output": 6, "cacheReadInput": 70}, turnTokenUsage=[{"turn": 1, "input": 3, "output": 4, "vendor": " "}, {"turn": 2, "input": 2, "output": 2, "model": "m"}])))
    (tmp_path / "bad.json").write_text("{nope")
    return str(tmp_path)


def test_runs(spark, run_folder):
    rows = readers.run_records(spark, run_folder).collect()
    assert [(r.id, r.status) for r in rows] == [("r2", "completed"), ("r1", "completed")]
    assert [r.id for r in readers.run_records(spark, run_folder, newest=1).collect()] == ["r2"]


def test_events_of_runs(spark, run_folder):
    rows = readers.events_of_runs(readers.run_records(spark, run_folder)).collect()
    assert sorted((r.input, r.output, r.cache_read, r.calls) for r in rows) == [(0, 0, 70, 0), (2, 2, 0, 1), (3, 4, 0, 1), (100, 10, 0, 1)]
    assert {r.model for r in rows} == {"unknown", "m"} and {r.vendor for r in rows} == {"unknown"}


def test_events_of_log(spark, tmp_path):
    lines = [
        json.dumps({"timestamp": "2026-02-01T00:00:00Z", "event": "analyze_token_usage", "detail": json.dumps({"calls": 2, "inputTokens": 30, "outputTokens": 7})}),
        "",
        "not json",
        json.dumps({"timestamp": "2026-02-02T00:00:00Z", "event": "smart_add_token_usage", "detail": json.dumps({"calls": 1, "inputTokens": 5, "vendor": "v"})}),
        json.dumps({"timestamp": "2026-02-03T00:00:00Z", "event": "other", "detail": "x"}),
        json.dumps({"timestamp": "2026-02-04T00:00:00Z", "event": "analyze_token_usage", "detail": "broken"}),
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    entries = readers.log_entries(spark, str(tmp_path / "log.jsonl"))
    assert entries.count() == 4
    assert sorted((r.command, r.input, r.output, r.calls, r.vendor) for r in readers.events_of_log(entries).collect()) == [("analyze", 30, 7, 2, "unknown"), ("smart-add", 5, 0, 1, "v")]


def test_inventory(spark, tmp_path):
    for name, data in {"a.py": b"x\ny\n", "b.ts": b"one\ntwo", "c.bin": b"\0\n\n", "node_modules/z.js": b"no\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.inventory(spark, str(tmp_path)).collect()}
    assert {k: (r.lines, r.language, r.size) for k, r in rows.items()} == {"a.py": (2, "Python", 4), "b.ts": (2, "TypeScript", 7), "c.bin": (0, "Other", 3)}


def test_history(spark):
    text = "\x1e".join(["\x1f".join(["s1", "p1 p2", "2026-01-01", "Ada", "subject", "body"]), "\x1f".join(["short", "record"]), "\x1f".join(["s2", "p1", "2026-01-02", "Bo", "x", ""])])
    rows = readers.merge_commits(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(r.sha, r.parents) for r in rows] == [("s1", ["p1", "p2"]), ("s2", ["p1"])]
    lines = ["commit s1", "M\ta.py", "R100\told.py\tnew.py", "commit s2", "A\tb.py"]
    table = spark.createDataFrame([("f", n, x) for n, x in enumerate(lines)], "file string, n int, line string")
    assert sorted((r.sha, r.status, r.path, r.old_path) for r in readers.changed_files(table).collect()) == [("s1", "M", "a.py", None), ("s1", "R", "new.py", "old.py"), ("s2", "A", "b.py", None)]
    counts = spark.createDataFrame([("3\t4\ta",), ("-\t-\tb",), ("1\t0\tc",)], "line string")
    assert readers.line_totals(counts).first()[:] == (4, 4)
    module = "module x.org/a\nrequire (\n\tgithub.com/p/q v1.2.3\n)\nrequire golang.org/x/t v0.1.0\n"
    assert sorted(map(tuple, readers.module_requirements(spark.createDataFrame([(module,)], "text string")).collect())) == [("github.com/p/q", "v1.2.3"), ("golang.org/x/t", "v0.1.0")]


def test_folder_tree_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("e1", "epic", "pending", None, "Epic", "text", ["x", "k:v"], [], []), ("t1", "task", "in_progress", "high", "Task", None, [], ["e9"], ["works", "fast"])], "id string, level string, status string, priority string, title string, description string, tags array<string>, blocked_by array<string>, acceptance array<string>")
    folder = {"e1": tmp_path / "epic", "t1": tmp_path / "epic" / "task"}
    for r in writers.markdown(items).collect():
        folder[r.id].mkdir(exist_ok=True)
        (folder[r.id] / "index.md").write_text(r.text)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "index.md").write_text("---\n: : :\n---\n")
    rows = readers.with_parents(readers.folder_tree(spark, str(tmp_path)))
    assert rows.where("warning is not null").count() == 1
    back = rows.where("warning is null").select(*items.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, items.collect()))
    assert {r.id: r.parent_id for r in rows.where("id is not null").collect()} == {"e1": None, "t1": "e1"}


def test_tracker_items(spark):
    rows = spark.createDataFrame([("A", None, "Epic", "Done", "a"), ("B", "A", "Story", "To Do", "b"), ("C", "Z", "odd", "odd", "c")], "key string, parent string, kind string, state string, name string")
    got = readers.tracker_items(rows, "key", "parent", "kind", {"epic": "epic", "story": "feature"}, "state", {"done": "completed", "to do": "pending"}, "name")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("A", None, "epic", "completed", "a"), ("B", "A", "feature", "pending", "b"), ("C", None, "task", "pending", "c")], key=str)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "n int, g string")
    writers.by_group(rows, str(tmp_path / "g"), "g")
    writers.by_group(rows.where("g = 'a'").limit(1), str(tmp_path / "g"), "g")
    assert sorted((r.n, r.g) for r in spark.read.json(str(tmp_path / "g")).collect() if r.g == "b") == [(2, "b")]
    writers.archive(rows, str(tmp_path / "z"))
    assert spark.read.json(str(tmp_path / "z")).count() == 3 and list((tmp_path / "z").glob("*.gz"))
    writers.canonical_json(rows, str(tmp_path / "c"), "n")
    assert [r.n for r in spark.read.json(str(tmp_path / "c")).orderBy("n").collect()] == [1, 2, 3]
    assert [r.n for r in writers.capped(rows, rows.withColumn("n", F.col("n") + 10), "n", 4).collect()] == [13, 12, 11, 3]
    assert [r.g for r in writers.numbered_duplicates(rows.withColumn("k", F.lit(1)), "k", "g", "n").orderBy("n").collect()] == ["a", "b", "a-2"]


def test_each_run_file_is_one_value(spark, sf_dir):
    from tarnworks.plans import sources

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as where the groups fill several partitions
    try:
        folder = sources.run_folder(spark, sf_dir)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = spark.read.text(folder).select(F.col("_metadata.file_path").alias("file")).groupBy("file").count()
    assert {r["count"] for r in lines.collect()} == {1} and lines.count() == 16
    assert readers.run_records(spark, folder).count() == spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
