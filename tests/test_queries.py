"""Every query with a SQL counterpart gives the same rows in DuckDB."""

import glob
import os

import duckdb
import pytest

from lattiq.plans.catalog import ORACLE, QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return v
    return float(v)


def _same(a, b):
    return abs(a - b) <= 2e-6 * max(1.0, abs(a)) if isinstance(a, float) and isinstance(b, float) else a == b


def _key(row):
    return tuple((x is not None, str(type(x)), round(x, 4) if isinstance(x, float) else x if x is not None else 0) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    res = duck.execute(ORACLE[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=_key)
    assert len(got) == len(want)
    assert all(_same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))
    spark.catalog.clearCache()
