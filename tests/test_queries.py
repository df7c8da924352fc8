"""Each registered query against its SQL in DuckDB, on the same tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from rillflow.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(x):
    if isinstance(x, (pd.Timestamp,)):
        return x.to_pydatetime().replace(tzinfo=None)
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df[names].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert name in ORACLES
    want = con.execute(ORACLES[name]).fetch_df()
    (a, x), (b, y) = rows(got), rows(want)
    assert a == b
    assert len(x) == len(y)
    for r, s in zip(x, y):
        assert r == s or all(u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-12)) for u, v in zip(r, s)), (r, s)
