"""Every registered query runs on the smallest tables and agrees with its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from sparkreel.plans import catalog
from tools.check import compare, norm


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_entry(spark):
    assert contract.entry(spark).count() == 33


def test_every_query_has_sql():
    assert set(catalog.all_queries()) == set(catalog.all_oracles())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(catalog.all_queries()))
def test_query(spark, sf, duck, name):
    df = contract.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    problem, rows = compare(got, want)
    assert problem is None, rows
