"""The text queries that have SQL against DuckDB, on the smallest tables, and their plans' promises."""

from __future__ import annotations

import gc
import os

import duckdb
import pytest

import corpus_pipeline
from pushflow.llm import common, queries

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.select(*(f'"{c}"' for c in columns)).fetchall(), key=key)


def test_native_query_has_no_python(spark):
    plan = queries.op6_decontaminate(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_stages_begin_with_heaps_given_back(spark, monkeypatch):
    """What the stages before have left in the executors' heaps goes before a stage's own work starts."""
    left = spark._jvm.java.lang.Object()  # a local session's executor has the driver's heap
    seen = spark._jvm.java.lang.ref.WeakReference(left)
    del left
    gc.collect()
    common.rest(spark)
    assert seen.get() is None

    class Rested(Exception):
        pass

    def rest(_):
        raise Rested

    monkeypatch.setattr(corpus_pipeline, "rest", rest)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Rested):
            stage(spark, None, DATA)
