"""Every registered query of the library against its SQL in DuckDB, and rows for those that SQL cannot say."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from fieldlens.plans import catalog, evidence, feeds, records, registry, reviews, worklists  # noqa: F401  these register their queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    sql = registry.oracle_sql().get(name)
    if sql:
        found = duck.sql(sql)
        want = rows(found.columns, found.fetchall())
        assert got[0] == want[0]
        assert got[1] == want[1]
