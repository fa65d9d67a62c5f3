"""Every query with SQL gives the same rows in DuckDB, and none of them is empty."""

import os

import duckdb
import pytest

from lodestar import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def value(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, data, name):
    frame = catalog.queries()[name](spark, data)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert got
    sql = catalog.oracle_sql().get(name)
    if sql:
        cursor = duck.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(frame.columns)
        assert got == rows(names, cursor.fetchall())


def test_sql_belongs_to_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert os.path.isdir("/root/testdata")
