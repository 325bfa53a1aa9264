"""Every registered query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import hashlib
import os
from decimal import Decimal

import duckdb
import pytest

from pushflow.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "events", "pages")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    return int(value) if isinstance(value, Decimal | float) and value == int(value) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    left = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=key)
    right = sorted((tuple(map(plain, r)) for r in want.select(*(f'"{c}"' for c in columns)).fetchall()), key=key)
    assert left == right


def test_failover_backfills_more_than_a_listing(spark, tmp_path):
    """A gained partition may hold more records of a topic than a restart lists."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    user = next(u for u in range(99) if int(hashlib.md5(f"default|view|{u}".encode()).hexdigest()[:15], 16) % 4 == 2)
    con.sql(f"CREATE OR REPLACE VIEW events AS SELECT range AS event_id, TIMESTAMP '2024-01-01' AS ts, {user} AS user_id, 'view' AS event_type, 1.0 AS value, '{{}}' AS props FROM range(90_000)")
    con.sql(f"COPY (FROM events) TO '{tmp_path}/events.parquet'")
    got = QUERIES["leader_failover_backfill"](spark, str(tmp_path)).collect()
    want = con.sql(ORACLE_SQL["leader_failover_backfill"]).fetchall()
    assert len(want) > 50_000
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
