"""Every query that has SQL gives the rows of that SQL."""

import os

import pytest

from graphloom import registry

DATA = "/root/testdata/sf0.001"
SLOW = {"mga", "mga_bulk", "bgd"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def rounded(rows):
    plain = [tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in r) for r in rows]
    return sorted(plain, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_every_query_is_named_once():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    names = sorted(got.columns)
    want = duck.execute(registry.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in duck.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    a, b = rounded(tuple(r) for r in got.select(*names).collect()), rounded(tuple(r[i] for i in at) for r in want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-5)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
