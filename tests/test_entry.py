"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from respanel.plans import catalog


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    flat = [tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in (r[k] for k in order)) for r in rows]
    return sorted(flat)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, tables, name):
    df = catalog.queries()[name](spark, sf)
    rel = tables.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    mine = rows_of(df.columns, [tuple(float(v) if hasattr(v, "as_tuple") else v for v in r) for r in df.collect()])
    other = rows_of(rel.columns, [tuple(float(v) if hasattr(v, "as_tuple") else v for v in r) for r in rel.fetchall()])
    assert len(mine) == len(other)
    for a, b in zip(mine, other, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or abs(float(x) - float(y)) < 2e-5


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25


def test_all_have_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
