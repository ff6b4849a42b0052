"""Queries of the training-data operators against their SQL twins."""

import duckdb
import pytest

from docketlab.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", sorted(queries.ORACLES))
def test_query_equals_sql(spark, query):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    want = con.sql(queries.ORACLES[query])
    got = queries.QUERIES[query](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    rows = lambda names, data: sorted(tuple(r[list(names).index(c)] for c in cols) for r in data)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
