from __future__ import annotations

from pathlib import Path

import pytest
from helpers import DAY, NOW, SECOND, log_row, plan_of

from loomlog.operators.checks import split_bad_ids
from loomlog.operators.dedup import diff_tables
from loomlog.plans import search
from loomlog.schema import LOGS, RESULT_COLUMNS
from loomlog.sources import logs as store
from loomlog.sources.keys import read_api_keys, write_api_keys
from loomlog.sources.logs import (
    append_logs,
    apply_retention,
    compact_days,
    drop_expired_days,
    read_logs,
    scan_logs,
)


def rows_of(spark, days=4, per_day=25):
    return spark.createDataFrame(
        [
            log_row(f"t{i % 3}", NOW - d * DAY - i, service=f"s{i % 2}", trace=f"{d * 100 + i:032x}",
                    span=f"{i:016x}", body=f"row {d} {i}", attrs={"http.method": "GET", "n": str(i)},
                    resource={"service.name": f"s{i % 2}"})
            for d in range(days) for i in range(per_day)
        ],
        LOGS,
    )


def test_round_trip_and_repeated_load(spark, tmp_path):
    path, rows = str(tmp_path / "logs"), rows_of(spark)
    append_logs(rows.filter("tenant_id <> 't2'"), path, "one")
    append_logs(rows.filter("tenant_id = 't2'"), path, "two")
    append_logs(rows.filter("tenant_id <> 't2'"), path, "one")
    stored = read_logs(spark, path).select(*LOGS.names)
    assert diff_tables(rows, stored).count() == 0
    assert tuple(scan_logs(spark, path).columns) == RESULT_COLUMNS
    assert read_logs(spark, path).where("day <> to_date(timestamp_seconds(ts div 1000000000))").count() == 0


def test_files_are_clustered_and_carry_a_trace_filter(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "logs")
    append_logs(rows_of(spark, days=1, per_day=400), path, "one")
    files = sorted(Path(path).glob("day=*/**/*.parquet"))
    for file in files:
        table = pq.read_table(file, columns=["tenant_id", "service", "ts"]).to_pylist()
        order = [(r["tenant_id"], r["service"], r["ts"]) for r in table]
        assert order == sorted(order)
    meta = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(
            spark._jvm.org.apache.hadoop.fs.Path(str(files[0])), spark._jsc.hadoopConfiguration()
        )
    )
    column = next(
        c for c in meta.getFooter().getBlocks()[0].getColumns() if "trace_id" in c.toString()
    )
    assert column.getBloomFilterOffset() > 0
    meta.close()


def test_searches_skip_days_and_push_filters(spark, tmp_path):
    path = str(tmp_path / "logs")
    append_logs(rows_of(spark), path, "one")
    found = search.log_query(
        read_logs(spark, path), "t1", [("service", "=~", "s0|s1"), ("n", "!=", "")],
        start=NOW - DAY - 1000, end=NOW - DAY, limit=10,
    )
    assert found.count() == 8
    plan = plan_of(found)
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    filters = plan[plan.index("PartitionFilters"):].split("\n")[0]
    assert "day#" in filters and "2024-01-29" in filters
    pushed = plan[plan.index("PushedFilters"):].split("\n")[0]
    for part in ("EqualTo(tenant_id,t1)", "GreaterThanOrEqual(ts", "LessThan(ts", "In(service"):
        assert part in pushed
    trace = search.trace_lookup(read_logs(spark, path), "t1", f"{1:032x}")
    assert trace.count() == 1
    assert "EqualTo(trace_id" in plan_of(trace)


def test_retention(spark, tmp_path):
    path, rows = str(tmp_path / "logs"), rows_of(spark)
    append_logs(rows, path, "one")
    now = NOW + 28 * DAY - 10
    kept = apply_retention(read_logs(spark, path), now)
    assert kept.count() == rows.filter(rows.ts >= now - 30 * DAY).count() > 0
    assert drop_expired_days(spark, path, now) == ["2024-01-27"]
    assert drop_expired_days(spark, path, now) == []
    assert apply_retention(read_logs(spark, path), now).count() == kept.count()


def test_wide_ids_are_set_aside(spark):
    rows = spark.createDataFrame(
        [log_row(trace="a" * 32, span="b" * 16), log_row(trace="a" * 33), log_row(span="é" * 9),
         log_row()], LOGS,
    )
    good, bad = split_bad_ids(rows)
    assert (good.count(), bad.count()) == (2, 2)


def test_keys_round_trip(spark, tmp_path):
    from test_tenants import keys

    write_api_keys(keys(spark), str(tmp_path / "keys"))
    assert sorted(read_api_keys(spark, str(tmp_path / "keys")).collect()) == sorted(
        keys(spark).collect()
    )


def test_smaller_replay_replaces_the_whole_load(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = [log_row(ts=NOW, body="today"), log_row(ts=NOW - 86_400 * SECOND, body="yesterday")]
    append_logs(spark.createDataFrame(rows, LOGS), path, "one")
    append_logs(spark.createDataFrame([log_row(ts=NOW, body="other")], LOGS), path, "two")
    append_logs(spark.createDataFrame(rows[:1], LOGS), path, "one")
    assert sorted(r.body for r in read_logs(spark, path).collect()) == ["other", "today"]
    append_logs(spark.createDataFrame([], LOGS), path, "one")
    assert [r.body for r in read_logs(spark, path).collect()] == ["other"]


def test_days_are_compacted_and_listed_by_range(spark, tmp_path):
    path, day = str(tmp_path / "logs"), 86_400 * SECOND
    for load in range(4):
        rows = [log_row(ts=NOW - d * day, body=f"{load} {d}", trace=f"{load:032x}") for d in range(3)]
        append_logs(spark.createDataFrame(rows, LOGS), path, f"load-{load}")
    before = sorted(r.body for r in read_logs(spark, path).collect())
    assert len(compact_days(spark, path, NOW)) == 2  # the current day stays
    assert sorted(r.body for r in read_logs(spark, path).collect()) == before
    assert compact_days(spark, path, NOW) == []
    one = read_logs(spark, path, NOW - day, NOW - day + 1)
    assert len(one.inputFiles()) == 1 and "compacted" in one.inputFiles()[0]
    assert {r.body for r in one.collect()} == {f"{n} 1" for n in range(4)}
    assert read_logs(spark, path, 0, day).count() == 0
    late = spark.createDataFrame([log_row(ts=NOW - day, body="late")], LOGS)
    append_logs(late, path, "late")
    assert len(compact_days(spark, path, NOW)) == 1 and read_logs(spark, path).count() == 13


def put(spark, path, load, *bodies):
    append_logs(spark.createDataFrame([log_row(ts=NOW - DAY, body=b) for b in bodies], LOGS), path, load)


def bodies(spark, path):
    return sorted(r.body for r in read_logs(spark, path).collect())


@pytest.mark.parametrize("step", range(6))
def test_compaction_stopped_after_each_step_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, step):
    """The steps: copy, list, three deletes, move."""
    path, steps = str(tmp_path / "logs"), []
    for load in "abc":
        put(spark, path, load, load)

    def stopping(run):
        def one(*args):
            run(*args)
            steps.append(run.__name__)
            if len(steps) > step:
                raise KeyboardInterrupt

        return one

    with monkeypatch.context() as patch:
        for name in ("_write", "write_text", "delete", "move"):
            if hasattr(store, name):
                patch.setattr(store, name, stopping(getattr(store, name)))
        with pytest.raises(KeyboardInterrupt):
            compact_days(spark, path, NOW)
    put(spark, path, "late", "late")
    put(spark, path, "b", "b again")  # a replay of a load that the copy may hold
    compact_days(spark, path, NOW)
    assert bodies(spark, path) == ["a", "b again", "c", "late"]
    assert len(list(Path(path).glob("day=*/load_id=*"))) == 1
    put(spark, path, "late")
    assert bodies(spark, path) == ["a", "b again", "c"]


def test_compaction_whose_loads_are_all_deleted_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "logs")
    for load in "abc":
        put(spark, path, load, load)
    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(store, "move", lambda *_: (_ for _ in ()).throw(OSError()))
        compact_days(spark, path, NOW)
    assert len(compact_days(spark, path, NOW)) == 1
    assert bodies(spark, path) == ["a", "b", "c"] and compact_days(spark, path, NOW) == []


def test_replay_after_compaction_replaces_the_load(spark, tmp_path):
    path = str(tmp_path / "logs")
    for load in "ab":
        put(spark, path, load, f"{load}1", f"{load}2")
    compact_days(spark, path, NOW)
    put(spark, path, "a", "a1")
    assert bodies(spark, path) == ["a1", "b1", "b2"]
    compact_days(spark, path, NOW)
    put(spark, path, "b")
    put(spark, path, "a")
    assert bodies(spark, path) == []
