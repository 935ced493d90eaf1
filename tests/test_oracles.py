"""Every query with SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

from tarnworks.plans import columns, graphs, inventories, references, sources, stores, telemetry, texts, trees, workspaces, zoning

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CASES = [(plan, name) for plan in (telemetry, trees, graphs, inventories, texts, columns, references, zoning, sources, stores, workspaces) for name in plan.SQL]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, (int, bool)) else str(v)


@pytest.mark.parametrize(("plan", "name"), CASES, ids=[name for _, name in CASES])
def test_equals_sql(spark, duck, sf_dir, plan, name):
    df = plan.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    result = duck.execute(plan.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert sorted(got, key=str) == sorted(expected, key=str)
