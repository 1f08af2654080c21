"""Every registered query with SQL gives the same rows as DuckDB; the others are executed."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sitegrid import registry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return int(v) if v == int(v) else float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return int(v) if isinstance(v, bool) else v


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(registry.SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf_dir, name):
    """The others are executed; their results are held against brute force in test_domain."""
    df = registry.QUERIES[name](spark, LARGER if name in NEEDS_LARGER else sf_dir)
    assert df.columns and df.collect()


#: In each region of the smallest tables there is a cell that no locker reaches, so nothing is feasible there.
LARGER = "/root/testdata/sf0.01"
NEEDS_LARGER = {"e10_verified_plans", "e11_selection_outcomes"}


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
