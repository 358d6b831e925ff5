"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9)
    return a == b


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.plans.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SF)
    cursor = db.execute(entry.oracle_sql()[name])
    columns, want = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    want = sorted((tuple(r) for r in want), key=str)
    assert len(rows) == len(want)
    for x, y in zip(rows, want, strict=True):
        assert all(map(same, x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(entry.plans.QUERIES) - set(entry.plans.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["source_id", "new_docs"]
