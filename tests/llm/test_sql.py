"""The training-data queries against their SQL in DuckDB on the smallest test tables, where those are there."""

import os

import duckdb
import pandas as pd
import pytest

from larkspur.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    theirs = con.sql(ORACLES[name]).df()
    cols = sorted(theirs.columns)
    mine = QUERIES[name](spark, SF).toPandas()
    assert sorted(mine.columns) == cols
    plain = lambda df: sorted(map(str, (tuple(None if pd.isna(v) else round(v, 6) if isinstance(v, float) and v % 1 else int(v) if isinstance(v, float) else v for v in r) for r in df[cols].astype(object).values)))
    assert plain(mine) == plain(theirs)
