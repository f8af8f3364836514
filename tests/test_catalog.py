"""Every registered query against its SQL twin, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest
from catalog import fixtures
from catalog.registry import ORACLES, QUERIES

import __spark_entry__ as entry
from loomlog.operators.ordering import latest_logs
from loomlog.plans import search
from loomlog.schema import RESULT_COLUMNS
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return database


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, connection, name):
    ok, text = compare(spark, connection, SF, name)
    assert ok, text


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)


def test_isolation_check_sees_a_leak_below_the_newest_5000(spark, monkeypatch):
    whole = search.log_query

    def leaking(table, *args, limit, max_limit=5000, **more):
        """A search that returns another tenant's oldest row as well."""
        leak = table.filter("tenant_id = 'tenant-2'").orderBy("ts").limit(1).select(*RESULT_COLUMNS)
        rows = whole(table, *args, limit=None, max_limit=None, **more).unionByName(leak)
        return latest_logs(rows, limit, max_limit=max_limit)

    monkeypatch.setattr(search, "log_query", leaking)
    row = QUERIES["tenant_isolation_check_whole"](spark, "/root/testdata/sf0.1").first()
    assert row.own_violations == 1 and row.returned > 5001


def test_reconcile_shows_a_difference_of_every_tenant(spark):
    rows = QUERIES["reconcile_counts_whole"](spark, SF).collect()
    stored = {r.tenant_id: r.stored for r in rows}
    assert stored["tenant-2"] == fixtures.logs(spark, SF).filter("tenant_id = 'tenant-2'").count() > 0
