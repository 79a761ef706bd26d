"""Every registered query runs, and equals its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def tidy(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(made, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = tidy(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    res = duck.execute(ORACLES[name])
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(df.columns)
    want = tidy(columns, res.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for x, y in zip(g, w):
            assert x == (pytest.approx(y, rel=1e-6, abs=2e-5) if isinstance(y, float) else y)


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
