"""The registered queries against their SQL twins, and the pipeline."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pixelflow.llm import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df, twin = entry.queries()[name](spark, DIR), con.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(twin.columns) == order
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == sorted(repr(tuple(r[twin.columns.index(c)] for c in order)) for r in twin.fetchall())


def test_ten_operators_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR).cache()
        if name != "byte_bpe":
            assert out.columns == columns and out.count() <= before
        docs, before = out, out.count()
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in corpus_pipeline.run(spark, DIR).collect())
