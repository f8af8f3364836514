from __future__ import annotations

import json

import pytest
from catalog import fixtures
from helpers import NOW, log_row
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomlog.operators.dedup import diff_tables
from loomlog.operators.mapping import map_batches
from loomlog.plans.alerts import alert_rates, flush_counts, flush_p99, flush_p99_approx, flush_p99_of_counts
from loomlog.schema import LOGS
from loomlog.sources.export import read_export_batches
from loomlog.sources.logs import append_logs, read_logs
from loomlog.streaming import ingest
from loomlog.streaming.dedup import stream_dedup
from loomlog.streaming.windows import newest_windows, stream_windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landing") / "batches")
    fixtures.export_batches(spark, SF).repartition(4, "request_id").write.parquet(path)
    return path


def start(spark, landing, out, **options):
    source = read_export_batches(spark, landing, "parquet", streaming=True, maxFilesPerTrigger=1)
    return ingest.stream_ingest(
        source, lambda: fixtures.api_keys(spark, SF), f"{out}/logs", f"{out}/checkpoint",
        f"{out}/dead", metrics=f"{out}/metrics", now_ns=NOW, available_now=True, **options,
    )


def batch_rows(spark, landing):
    batches = read_export_batches(spark, landing, "parquet")
    return map_batches(batches, fixtures.api_keys(spark, SF), NOW)


def stored_rows(spark, out):
    return read_logs(spark, f"{out}/logs").select(*LOGS.names)


def test_stream_equals_batch_also_after_a_crash(spark, landing, tmp_path):
    out = str(tmp_path)
    stored = []

    def crashes_in_the_second_batch(rows, path, load_id):
        append_logs(rows, path, load_id)
        stored.append(load_id)
        if load_id.endswith("1"):
            raise OSError("the answer is lost")

    # Dead letters cannot be written either, so the stream ends with an error.
    (tmp_path / "dead").write_text("in the way")
    with pytest.raises(StreamingQueryException):
        start(spark, landing, out, write=crashes_in_the_second_batch).awaitTermination(120)
    assert len(set(stored)) == 2
    # The second micro-batch was stored but not committed; it runs again.
    start(spark, landing, out).awaitTermination(120)
    want = batch_rows(spark, landing)
    assert diff_tables(want, stored_rows(spark, out)).count() == 0
    metrics = spark.read.parquet(f"{out}/metrics")
    assert metrics.agg(F.sum("rows")).first()[0] == want.count()
    # New files are picked up by the next run, old ones are not stored again.
    start(spark, landing, out).awaitTermination(120)
    assert stored_rows(spark, out).count() == want.count()


def test_failed_flushes_end_in_the_dead_letters(spark, landing, tmp_path):
    out, attempts = str(tmp_path), []

    def fails_on_the_first_batch(rows, path, load_id):
        attempts.append(load_id)
        if load_id.endswith("0"):
            raise OSError("disk on fire")
        append_logs(rows, path, load_id)

    start(spark, landing, out, write=fails_on_the_first_batch).awaitTermination(120)
    assert attempts.count(attempts[0]) == 3
    dead = spark.read.schema(LOGS).parquet(f"{out}/dead/load_id={attempts[0]}")
    both = stored_rows(spark, out).unionByName(dead)
    assert dead.count() > 0
    assert diff_tables(batch_rows(spark, landing), both).count() == 0
    dropped = spark.read.parquet(f"{out}/metrics").filter("drop_reason = 'flush_error'")
    assert [r.rows for r in dropped.collect()] == [dead.count()]


def test_second_attempt_succeeds(spark, landing, tmp_path):
    out, attempts = str(tmp_path), []

    def fails_once(rows, path, load_id):
        attempts.append(load_id)
        append_logs(rows, path, load_id)
        if len(attempts) == 1:
            raise OSError("lost the answer, not the rows")

    start(spark, landing, out, write=fails_once).awaitTermination(120)
    assert diff_tables(batch_rows(spark, landing), stored_rows(spark, out)).count() == 0


def test_rejects(spark, tmp_path):
    lines = [
        {"request_id": "good", "x_api_key": "key-1", "resource_logs": []},
        {"request_id": "revoked", "x_api_key": "key-3", "resource_logs": []},
        {"request_id": "silent", "resource_logs": []},
    ]
    (tmp_path / "in").mkdir()
    text = "\n".join(map(json.dumps, lines)) + "\n{broken\n"
    (tmp_path / "in" / "a.json").write_text(text)
    source = read_export_batches(spark, str(tmp_path / "in"), streaming=True)
    out = str(tmp_path / "out")
    ingest.stream_rejects(
        source, lambda: fixtures.api_keys(spark, SF), out, str(tmp_path / "cp"), available_now=True
    ).awaitTermination(120)
    got = {(r.request_id, r.outcome) for r in spark.read.parquet(out).collect()}
    assert got == {("revoked", "invalid_key"), ("silent", "missing_key"), (None, "unreadable_body")}


def test_dedup_within_and_across_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(*bodies):
        rows = [log_row(body=b, attrs={"x": b, "y": "1"}) for b in bodies]
        spark.createDataFrame(rows, LOGS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOGS).parquet(source)
        stream_dedup(
            stream, f"{out}/rows", f"{out}/seen", f"{out}/cp", horizon=2, available_now=True
        ).awaitTermination(120)
        return sorted(r.body for r in spark.read.schema(LOGS).parquet(f"{out}/rows").collect())

    assert run("a", "a", "b") == ["a", "b"]
    assert run("b", "c", "c") == ["a", "b", "c"]
    assert run("b", "d") == ["a", "b", "c", "d"]
    # Beyond the horizon of two micro-batches a repeat counts as new.
    assert run("a", "d") == ["a", "a", "b", "c", "d"]


def test_streamed_p99_is_within_its_bound(spark, tmp_path):
    events = fixtures.pipeline_events(spark, SF)
    exact = {r.window_start_us: r for r in flush_p99(events, "1 day").collect()}
    approximate = flush_p99_approx(events, "1 day").collect()
    values = {}
    for row in events.selectExpr("unix_micros(at) as us", "flush_us").collect():
        values.setdefault(row.us - row.us % 86_400_000_000, []).append(row.flush_us)
    for row in approximate:
        ordered = sorted(values[row.window_start_us])
        rank = ordered.index(row.p99)
        assert abs(rank - 0.99 * len(ordered)) <= 1 + len(ordered) / 10_000
        assert exact[row.window_start_us].max == row.max


def test_two_streams_feed_one_table(spark, landing, tmp_path):
    """Load ids hold the query's id, so streams with equal names don't replace each other."""
    want = batch_rows(spark, landing).count()
    for checkpoint in ("one", "two"):
        source = read_export_batches(spark, landing, "parquet", streaming=True, maxFilesPerTrigger=1)
        ingest.stream_ingest(
            source, lambda: fixtures.api_keys(spark, SF), f"{tmp_path}/logs", f"{tmp_path}/{checkpoint}",
            f"{tmp_path}/dead", now_ns=NOW, available_now=True,
        ).awaitTermination(120)
    assert stored_rows(spark, tmp_path).count() == 2 * want


def test_dedup_without_horizon_remembers_all(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for body in ("a", "b", "c", "a"):
        spark.createDataFrame([log_row(body=body)], LOGS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOGS).parquet(source)
        stream_dedup(stream, f"{out}/rows", f"{out}/seen", f"{out}/cp", available_now=True).awaitTermination(120)
    assert sorted(r.body for r in spark.read.schema(LOGS).parquet(f"{out}/rows").collect()) == ["a", "b", "c"]


def test_accepted_and_refused_come_from_one_decision(spark, tmp_path):
    """Every landed request is in one output, also when a key is revoked between attempts."""
    record = [{"scope_logs": [{"log_records": [{"time_unix_nano": NOW}]}]}]
    lines = [
        {"request_id": "good", "x_api_key": "key-1", "resource_logs": record},
        {"request_id": "typed", "x_api_key": "key-1", "content_type": "text/plain", "resource_logs": record},
        {"request_id": "large", "x_api_key": "key-1", "body_bytes": 1 << 40, "resource_logs": record},
        {"request_id": "silent", "resource_logs": record},
        {"request_id": "wrong", "x_api_key": "nobody", "resource_logs": record},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    keys, calls = fixtures.api_keys(spark, SF), []

    def load_keys():
        calls.append(1)
        return keys if len(calls) == 1 else keys.limit(0)

    def run(**options):
        source = read_export_batches(spark, str(tmp_path / "in"), streaming=True)
        return ingest.stream_ingest(
            source, load_keys, f"{tmp_path}/logs", f"{tmp_path}/cp", f"{tmp_path}/dead",
            rejects=f"{tmp_path}/rejects", now_ns=NOW, available_now=True, **options,
        ).awaitTermination(120)

    def stops(rows, path, load_id):
        raise OSError("not now")

    (tmp_path / "dead").write_text("in the way")
    with pytest.raises(StreamingQueryException):
        run(write=stops)
    run()  # the same batch again, with all keys gone
    assert read_logs(spark, f"{tmp_path}/logs").count() == 1
    refused = {(r.request_id, r.outcome) for r in spark.read.parquet(f"{tmp_path}/rejects").collect()}
    assert refused == {
        ("typed", "unsupported_content_type"), ("large", "body_too_large"), ("silent", "missing_key"),
        ("wrong", "invalid_key"), (None, "missing_key"),
    }


def test_late_rows_and_open_windows_of_a_stream_count(spark, tmp_path):
    """Four files in reverse order of time: all but the first lie behind a watermark."""
    rows = fixtures.pipeline_events(spark, SF)
    cuts = rows.selectExpr("percentile_approx(unix_micros(at), array(0.25, 0.5, 0.75))").first()[0]
    part = sum(((F.unix_micros("at") > cut).cast("int") for cut in cuts), F.lit(0))
    for number in (3, 2, 1, 0):
        rows.where(part == number).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(make, by, label):
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream, out = make(source), f"{tmp_path}/{label}"
        stream_windows(stream, f"{out}/rows", f"{out}/checkpoint", available_now=True).awaitTermination(120)
        return newest_windows(spark, f"{out}/rows", stream.schema, by)

    got = run(alert_rates, ("window_start_us",), "rates")
    assert sorted(got.collect()) == sorted(alert_rates(rows).collect())
    p99 = flush_p99_of_counts(run(flush_counts, ("window_start_us", "flush_us"), "flush"))
    columns = ("window_start_us", "n", "p99", "max")
    assert sorted(p99.select(*columns).collect()) == sorted(flush_p99(rows).select(*columns).collect())


def test_landed_files_for_dedup_follow_the_rows(spark, tmp_path, monkeypatch):
    from catalog import storage

    n = spark.read.parquet(f"{SF}/events.parquet").limit(900).withColumn("event_id", F.monotonically_increasing_id())
    n.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(storage, "ROWS_A_FILE", 100, raising=False)
    monkeypatch.setattr(storage, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    rows = storage.dedup_stream(spark, str(tmp_path))
    assert rows.count() == n.count()
    assert len(list((tmp_path / "copies").glob("*.parquet"))) == 3 * 9
    assert len(list((tmp_path / "dedup" / "rows").glob("batch=*"))) == 3


def test_a_stream_joins_the_keys_that_its_requests_ask_for(spark, landing, tmp_path, monkeypatch):
    handed = []

    def seen(requests, keys, *rest):
        handed.append(keys.count())
        return resolve(requests, keys, *rest)

    resolve = ingest.resolve_tenant
    monkeypatch.setattr(ingest, "resolve_tenant", seen)
    start(spark, landing, str(tmp_path)).awaitTermination(120)
    n = read_export_batches(spark, landing, "parquet").count()
    assert 0 < sum(handed) <= n < fixtures.api_keys(spark, SF).count()
    assert diff_tables(batch_rows(spark, landing), stored_rows(spark, str(tmp_path))).count() == 0
