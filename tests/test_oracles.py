"""Queries against DuckDB on the smallest test tables, where those are there."""

import math
import os

import duckdb
import pandas as pd
import pytest

from larkspur.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, float):
        return "None" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return "None" if v is None or v is pd.NA or v is pd.NaT else str(v)


def rows(df):
    return sorted(df.columns), sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    mine = rows(QUERIES[name](spark, SF).toPandas().astype(object))
    theirs = rows(con.sql(ORACLES[name]).df().astype(object))
    if mine != theirs:  # whole numbers with gaps are floats in pandas
        whole = lambda t: (t[0], [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in t[1]])
        assert whole(mine) == whole(theirs)
