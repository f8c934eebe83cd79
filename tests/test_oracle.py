"""Every query that has SQL gives the rows of its SQL; every other query runs."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def duck(small_dir):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(small_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{small_dir}/{f}')")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.7g}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-6 * max(1e-2, abs(a), abs(b))
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_of_sql(spark, duck, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    columns = sorted(df.columns)
    own = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    got = duck.execute(SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in at) for r in got.fetchall()]
    key = lambda r: tuple((x is None, f"{x:.4g}" if isinstance(x, float) else str(x)) for x in r)
    assert len(own) == len(theirs)
    for a, b in zip(sorted(own, key=key), sorted(theirs, key=key)):
        assert all(map(close, a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if n[0] == "p" and n.split("_")[0] in ("p4", "p5", "p6")))
def test_runs_without_sql(spark, small_dir, name):
    assert QUERIES[name](spark, small_dir).count() > 0


def test_entry_has_rows(spark, small_dir):
    assert entry.entry(spark).limit(1).count() == 1
