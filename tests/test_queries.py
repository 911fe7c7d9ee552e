"""Every query with a DuckDB counterpart against it, on the smallest tables."""

import datetime as dt

import duckdb
import pytest

from gneiss import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, dt.datetime)):
        return str(v)
    return repr(round(float(v), 6) + 0.0)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = sorted(tuple(norm(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(norm(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert a == b


def test_every_query_is_known_to_the_entry():
    import __spark_entry__

    assert catalog.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
