"""Every SQL-checked query against DuckDB on the smallest data."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from cohortlab.plans import catalog, oracles

SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return repr(round(v, 9) + 0.0)
        return str(v)

    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry_points.queries())
    assert {q.__name__ for q in catalog.SQL_CHECKED} == set(oracles.all_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, small, name):
    df = entry_points.queries()[name](spark, small)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = duck.sql(SQL[name])
    want = canonical(result.columns, result.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() > 0
