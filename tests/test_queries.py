"""Every query with SQL against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from astrolith.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(found):
    return sorted(tuple(map(str, r)) for r in found)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in entry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    ours, theirs = entry.queries()[name](spark, DATA), db.sql(entry.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a = rows(ours.select(*[f"`{c}`" for c in columns]).collect())
    assert a == rows(theirs.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["name", "id", "path", "file", "line", "ref_kind"]
