"""Every query of the core against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from gneiss.plans import registry


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(data + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x.tolist() if hasattr(x, "tolist") else x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, data, con, name):
    got, want = registry.QUERIES[name](spark, data).toPandas(), con.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_run(spark, data):
    for name in set(registry.QUERIES) - set(registry.SQL):
        registry.QUERIES[name](spark, data).count()
