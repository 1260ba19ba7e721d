"""Every query with SQL gives what DuckDB gives over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(p):
    def one(x):
        if hasattr(x, "tolist") and hasattr(x, "__len__"):
            return str(x.tolist())
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return ""
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    p = p[sorted(p.columns)]
    return sorted(tuple(map(one, r)) for r in p.astype(object).values.tolist())


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.toPandas()) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
