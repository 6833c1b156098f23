"""Every registered query of the catalog against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pixelflow.plans import catalog

DIR = "/root/testdata/sf0.001"
SLOW = {"roi_detect", "get_regions", "hierarchical_pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def text(v):
    return f"{v:.7g}" if isinstance(v, float) else repr(v)


#: Where a 10-row image is smaller than the twin's window.
TOO_SMALL = {"box_density_15"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLES) - TOO_SMALL))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    twin = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(twin.columns)
    order = sorted(df.columns)
    ours = sorted(tuple(text(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(text(r[twin.columns.index(c)]) for c in order) for r in twin.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - SLOW))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
