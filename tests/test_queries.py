"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loreweave.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    return con


def plain(rows):
    show = lambda v: [show(x) for x in v] if isinstance(v, (list, tuple)) else round(v, 6) if isinstance(v, float) else v
    return sorted((str([show(v) for v in r]) for r in rows))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    expected = duck.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({registry.SQL[name]})").fetchall()
    assert plain(map(tuple, got.select(*columns).collect())) == plain(expected)


def test_every_query_has_sql():
    assert set(registry.QUERIES) - set(registry.SQL) <= set(registry.ROWS_ONLY)
