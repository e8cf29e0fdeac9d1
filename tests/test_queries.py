"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from docloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "item"):
        return plain(v.item())
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in SQL:
        assert columns
        return
    rel = oracle.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(SQL) > 150
