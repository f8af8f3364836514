"""Windows from stored partials: late rows, replays, compaction, no state; dedup by day."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from helpers import DAY, NOW, log_row
from pyspark.sql import functions as F

from loomlog.plans.alerts import RATE_MERGES, SKETCH_MERGES, alert_rates, alert_sums, flush_sketches, p99_of_sketches, rates_of_sums
from loomlog.schema import LOGS
from loomlog.streaming import partials
from loomlog.streaming.dedup import stream_dedup
from loomlog.streaming.partials import compact_partials, merged, read_partials, stream_partials

EVENTS = "at timestamp, source string, status int, rows bigint, drop_reason string, clamped bigint, flush_us bigint"
FIRST = datetime(2024, 1, 10, 23, 50, tzinfo=timezone.utc)


def event(n, minutes):
    reason = [None, "flush_error", "buffer_full", "flush_panic"][n % 4]
    return (FIRST + timedelta(minutes=minutes), "query" if n % 5 == 0 else "ingest", [200, 429, 503][n % 3], n, reason, n % 2, n * 37 % 1000)


def land(spark, path, *rows):
    spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, partial=alert_sums, name="one"):
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_partials(source, partial, "w.start", str(tmp_path / "out"), str(tmp_path / name), available_now=True)
    query.awaitTermination()
    return query


def rates(spark, tmp_path, schema):
    found = rates_of_sums(merged(read_partials(spark, str(tmp_path / "out"), schema), ["w"], RATE_MERGES))
    return sorted(tuple(r) for r in found.collect())


def all_rates(spark, tmp_path):
    return sorted(tuple(r) for r in alert_rates(spark.read.schema(EVENTS).parquet(str(tmp_path / "in"))).collect())


def test_late_rows_replays_and_compaction_change_no_window(spark, tmp_path):
    schema = alert_sums(spark.createDataFrame([], EVENTS)).schema
    for minute in (0, 3, 20, 25):
        land(spark, str(tmp_path / "in"), *[event(n, minute + n % 7) for n in range(minute, minute + 30)])
    query = run(spark, tmp_path)
    assert rates(spark, tmp_path, schema) == all_rates(spark, tmp_path)
    assert all(not p["stateOperators"] for p in query.recentProgress)  # nothing is kept between micro-batches
    land(spark, str(tmp_path / "in"), *[event(n, -60 * 24 * 9 + n) for n in range(8)])  # nine days late
    run(spark, tmp_path)
    whole = all_rates(spark, tmp_path)
    assert rates(spark, tmp_path, schema) == whole
    # The last micro-batch runs again, as after a crash before its commit.
    commits = sorted((tmp_path / "one" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "one" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run(spark, tmp_path)
    assert rates(spark, tmp_path, schema) == whole
    out = str(tmp_path / "out")
    before = len(list(Path(out).glob("day=*/batch=*")))
    assert compact_partials(spark, out, schema, ["w"], RATE_MERGES, "2024-01-12")
    assert len(list(Path(out).glob("day=*/batch=*"))) < before
    assert rates(spark, tmp_path, schema) == whole
    assert compact_partials(spark, out, schema, ["w"], RATE_MERGES, "2024-01-12") == []
    run(spark, tmp_path)
    assert rates(spark, tmp_path, schema) == whole
    land(spark, str(tmp_path / "in"), *[event(n, n) for n in range(5)])
    run(spark, tmp_path)
    compact_partials(spark, out, schema, ["w"], RATE_MERGES, "2024-01-12")
    assert rates(spark, tmp_path, schema) == all_rates(spark, tmp_path)
    one_day = read_partials(spark, out, schema, "2024-01-11", "2024-01-11")
    assert {r.d for r in one_day.select(F.to_date("w.start").cast("string").alias("d")).collect()} == {"2024-01-11"}


@pytest.mark.parametrize("step", ["delete", "move"])
def test_compaction_stopped_in_between_is_finished(spark, tmp_path, monkeypatch, step):
    schema = alert_sums(spark.createDataFrame([], EVENTS)).schema
    for minute in range(4):
        land(spark, str(tmp_path / "in"), *[event(n, minute) for n in range(9)])
    run(spark, tmp_path)
    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(partials, step, lambda *_: (_ for _ in ()).throw(OSError()))
        compact_partials(spark, str(tmp_path / "out"), schema, ["w"], RATE_MERGES, "2024-02-01")
    compact_partials(spark, str(tmp_path / "out"), schema, ["w"], RATE_MERGES, "2024-02-01")
    assert rates(spark, tmp_path, schema) == all_rates(spark, tmp_path)


def test_sketches_merge_to_a_p99_near_the_exact_one(spark, tmp_path):
    for part in range(5):
        land(spark, str(tmp_path / "in"), *[event(n, n % 10) for n in range(part * 4000, part * 4000 + 4000)])
    run(spark, tmp_path, flush_sketches)
    schema = flush_sketches(spark.createDataFrame([], EVENTS)).schema
    found = merged(read_partials(spark, str(tmp_path / "out"), schema), ["w"], SKETCH_MERGES)
    rows = p99_of_sketches(found).collect()
    values = {}
    for n in range(20_000):
        values.setdefault(n % 10 // 5, []).append(n * 37 % 1000)
    assert len(rows) == 2
    for row, own in zip(sorted(rows), (sorted(values[k]) for k in sorted(values))):
        assert (row.n, row.max) == (len(own), own[-1])
        below, upto = sum(v < row.p99 for v in own), sum(v <= row.p99 for v in own)
        assert below <= len(own) * 1.01 and below - 0.02 * len(own) <= 0.99 * len(own) <= upto + 0.02 * len(own)
    assert max(len(r.sketch) for r in found.collect()) < 20_000  # of ten thousand values


def test_dedup_asks_only_the_days_of_the_micro_batch(spark, tmp_path, monkeypatch):
    from loomlog.streaming import dedup as module

    asked, real = [], module.seen_folders
    monkeypatch.setattr(module, "seen_folders", lambda *a: asked.append(real(*a)) or asked[-1])
    days = 8
    for d in [*range(days), *range(days)]:  # every day twice, the second time as a retry
        rows = spark.createDataFrame([log_row(ts=NOW - d * DAY, body=f"{d} {i}") for i in range(5)], LOGS)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(LOGS).parquet(str(tmp_path / "in"))
        stream_dedup(stream, f"{tmp_path}/rows", f"{tmp_path}/seen", f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert spark.read.schema(LOGS).parquet(f"{tmp_path}/rows/batch=*").count() == days * 5
    assert [len(a) for a in asked] == [0] * days + [1] * days
