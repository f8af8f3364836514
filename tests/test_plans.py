"""The plans are the ones we want: what is shuffled, pushed down and generated."""

from __future__ import annotations

import re

from catalog import fixtures, mapping, reports, search, storage  # noqa: F401 (they register)
from catalog import tenants as _  # noqa: F401
from catalog.registry import QUERIES
from helpers import NOW, log_row, plan_of
from pyspark.sql import functions as F

from loomlog.operators import aggregates, tenants
from loomlog.operators.checks import isolation_violations
from loomlog.operators.dedup import dedup, diff_tables
from loomlog.operators.mapping import map_batches
from loomlog.plans.search import log_query
from loomlog.schema import EXPORT_BATCHES, LOGS
from loomlog.sources.logs import append_logs, read_logs

SF = "/root/testdata/sf0.001"


def stored(spark, tmp_path):
    path = str(tmp_path / "none")
    append_logs(spark.createDataFrame([log_row()], LOGS), path, "one")
    return read_logs(spark, path)


def shuffles(plan):
    return re.findall(r"^\(\d+\) Exchange\b", plan, re.M)


def test_mapping_has_no_shuffle_and_unfolds_in_generated_code(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], EXPORT_BATCHES).write.parquet(path)
    batches = spark.read.schema(EXPORT_BATCHES).parquet(path)
    rows = map_batches(batches, fixtures.api_keys(spark, SF), NOW)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert not shuffles(plan)
    assert "Python" not in plan and "BroadcastHashJoin" in plan
    unfolding = re.findall(r"^.*(?:Generate|Project|BroadcastHashJoin) \(\d+\)$", plan, re.M)
    # Only the last projection, for values that are not text, is outside.
    assert [line for line in unfolding if "* " not in line] == unfolding[:1]


def test_only_needed_columns_are_read(spark, tmp_path):
    logs = stored(spark, tmp_path)
    plan = plan_of(aggregates.top_services(logs))
    assert "ReadSchema: struct<service:string>" in plan and len(shuffles(plan)) == 1
    plan = plan_of(aggregates.severity_over_time(logs, 0, NOW, 3600 * 10**9))
    assert "ReadSchema: struct<ts:bigint,severity:string>" in plan
    assert "day#" in plan[plan.index("PartitionFilters"):].split("\n")[0]


def test_isolation_check_does_not_shuffle_the_logs(spark, tmp_path):
    logs = stored(spark, tmp_path)
    result = log_query(logs, "a", [("service", "!=", "")], now_ns=NOW)
    plan = plan_of(isolation_violations(logs, "a", result))
    assert "BroadcastHashJoin" in plan
    # The returned rows' fingerprints (used twice) and the counts per fingerprint.
    assert len(shuffles(plan)) <= 4


def test_one_shuffle_after_a_map_side_combine(spark, tmp_path):
    logs = stored(spark, tmp_path)
    for frame in (dedup(logs), diff_tables(logs, logs), aggregates.count_by_trace(logs)):
        plan = plan_of(frame)
        assert len(shuffles(plan)) == 1
        assert "SortAggregate" not in plan and "SortMergeJoin" not in plan


def test_large_key_tables_are_not_broadcast(spark):
    requests = fixtures.requests(spark, SF)
    keys = fixtures.api_keys(spark, SF)
    small = plan_of(tenants.resolve_tenant(requests, keys))
    assert "BroadcastHashJoin" in small and not shuffles(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = plan_of(tenants.resolve_tenant(requests, keys))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in large
    assert "SortMergeJoin" in large and len(shuffles(large)) == 2


def test_ranking_keeps_window_partitions_bounded(spark):
    frame = spark.range(10).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    plan = plan_of(aggregates.latency_summary(frame, "v", ["g"]))
    for line in re.findall(r"windowspecdefinition\(([^)]*?) ASC", plan):
        assert "_high" in line or "_mid" in line
    assert plan.count("Range (") <= 6 and len(shuffles(plan)) <= 10


def test_no_query_crosses_rows_or_runs_python(spark):
    whole = {"tenant_isolation_check", "roundtrip_check", "dedup"}  # join single rows of counts
    assert len(QUERIES) > 80
    # Patterns Java cannot run in linear time, and typed trees of any depth.
    arrow = {"line_match", "line_not_match", "read_export_standard", "map_export_standard", "stringify_nested_trees"}
    streams = {name for name in QUERIES if name.startswith("stream") or name == "batch_metrics"}
    for name in set(QUERIES) - streams:
        plan = plan_of(QUERIES[name](spark, SF))
        assert name in arrow or ("Python" not in plan and "Arrow" not in plan), name
        if name not in whole:
            assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
