"""Queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from rillflow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    got = QUERIES[name](spark, folder)
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=str)
    assert sorted(columns) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=str) == want
