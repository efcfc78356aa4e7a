"""Every query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest
from graphloom.llm import queries

from .cases import same

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = queries.queries()[name](spark, DATA)
    want = con.execute(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    rounded = lambda rs: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rs]
    assert rows
    same(rounded(got.collect()), rounded(rows))
