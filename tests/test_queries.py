"""Every registered query with SQL, against DuckDB on the smallest tables; the others must give rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from folioscope import plans

DATA = "/root/testdata/sf0.001"


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    return str(v)[:10] if hasattr(v, "isoformat") else str(v)


def rows(df):
    columns = [[cell(v) for v in df[c].tolist()] for c in sorted(df.columns)]
    return sorted(zip(*columns), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, DATA).toPandas()
    if name in plans.SQL:
        expected = duck.sql(plans.SQL[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)
    else:
        assert len(found)
