"""Every registered query against its DuckDB oracle; those without one must run and give rows of a stable schema."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from mailprism.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    q = REGISTRY[name]
    df = q.run(spark, SF)
    names = sorted(df.columns)
    got = sorted(([norm(r[c]) for c in names] for r in df.collect()), key=repr)
    assert len(set(names)) == len(names) and q.ids
    if q.sql is None:
        return
    cursor = duck.execute(q.sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    want = sorted(([norm(dict(zip(columns, r))[c]) for c in names] for r in cursor.fetchall()), key=repr)
    assert got == want
