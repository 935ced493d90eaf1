"""Table functions, and durations of items without intervals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnworks.functions import scalars, tables
from tarnworks.sources.formats import converted


def test_lines_of_a_log(spark):
    tables.registered(spark)
    text = '{"k": 9007199254740993, "at": "é", "on": true}\n\n{"k": null, "at": {"x": [1]}}\nbroken\n[1]\n {"k": 1.5, "v": 2, "at": 7, "on": 1}\n{"k": NaN, "v": Infinity}\n{"k": 4.0, "v": "2"}'
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (9007199254740995, '{"k": 2}'), (None, '{"k": 3}')], "id long, text string")
    got = spark.sql("SELECT q.id, r.* FROM {rows} q, LATERAL json_lines(q.text, 'k bigint, at string, v double, on boolean') r", rows=rows)
    assert got.dtypes == [("id", "bigint"), ("place", "int"), ("k", "bigint"), ("at", "string"), ("v", "double"), ("on", "boolean")]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] or 0, r[1])) == [
        (None, 0, 3, None, None, None),
        (1, 0, 9007199254740993, "é", None, True),
        (1, 2, None, '{"x": [1]}', None, None),
        (1, 5, None, "7", 2.0, None),
        (1, 6, None, None, float("inf"), None),
        (1, 7, 4, None, None, None),
        (9007199254740995, 0, 2, None, None, None),
    ]
    with pytest.raises(Exception, match="name type"):
        spark.sql("SELECT * FROM json_lines('{}', 'k decimal')").collect()
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT r.* FROM {rows} q, LATERAL json_lines(q.text, q.text) r", rows=rows).collect()


def test_parts_of_a_search(spark):
    tables.registered(spark)
    rows = spark.createDataFrame([(1, 'the "Exact Phrase" cache OR api!'), (2, "of the"), (3, None), (4, '"" "x')], "id int, raw string")
    got = spark.sql("SELECT q.id, p.* FROM {rows} q, LATERAL query_parts(q.raw) p", rows=rows).collect()
    assert {tuple(r) for r in got} == {(1, "phrase", "exact phrase", True), (1, "term", "cache", True), (1, "term", "api", True), (4, "term", "x", False)}


def test_numbers_that_are_none(spark):
    for kind in (tables.KINDS["bigint"], tables.KINDS["double"]):
        assert converted(True, kind) is None and converted("1", kind) is None
    assert converted(float("nan"), tables.KINDS["bigint"]) is None and converted(2**63, tables.KINDS["bigint"]) is None


def test_elapsed_time_falls_back_to_start_and_end(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    hour = 3_600_000
    cases = [
        ("completed", [(at(1), at(3)), (at(5), at(4)), (None, at(9))], at(0), at(9), None, 2 * hour),
        ("in_progress", [(at(10), None)], at(0), None, None, 2 * hour),
        ("completed", [], at(1), None, at(4), 3 * hour),
        ("completed", None, at(1), at(2), at(4), hour),
        ("completed", None, at(5), at(2), at(9), 0),
        ("in_progress", None, at(5), at(6), None, 7 * hour),
        ("in_progress", None, at(13), None, None, 0),
        ("completed", None, at(5), None, None, 0),
        ("pending", None, None, at(6), None, 0),
        (None, None, at(1), at(2), None, hour),
    ]
    schema = "k int, status string, intervals array<struct<start:timestamp,end:timestamp>>, started timestamp, ended timestamp, completed timestamp"
    rows = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(cases)], schema)
    ms = scalars.elapsed_ms(*(F.col(c) for c in ("status", "intervals", "started", "ended", "completed")), F.lit("2024-01-01 12:00:00").cast("timestamp"))
    assert [r.ms for r in rows.select("k", ms.alias("ms")).orderBy("k").collect()] == [c[5] for c in cases]
