"""The stored table: write, read back, retention, checks; and the streams that fill it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.operators.checks import split_bad_ids
from loomlog.operators.dedup import dedup as drop_copies
from loomlog.operators.dedup import diff_stored
from loomlog.plans import search
from loomlog.plans.alerts import (
    RATE_MERGES,
    SKETCH_MERGES,
    alert_rates,
    alert_sums,
    flush_counts,
    flush_p99_approx,
    flush_p99_of_counts,
    flush_sketches,
    p99_of_sketches,
    rates_of_sums,
)
from loomlog.session import scratch_path
from loomlog.sources.export import read_export_batches
from loomlog.sources.logs import append_logs, apply_retention, compact_days, read_logs, scan_logs
from loomlog.sources.traces import read_trace_logs
from loomlog.streaming.dedup import stream_dedup
from loomlog.streaming.ingest import stream_ingest, stream_rejects
from loomlog.streaming.partials import compact_partials, merged, read_partials, stream_partials
from loomlog.streaming.windows import newest_windows, stream_windows

from .fixtures import (
    DAY,
    FLAT,
    KEYS_SQL,
    LOGS_SQL,
    MONTH_START,
    NOW,
    PIPELINE_SQL,
    RECORDS_SQL,
    api_keys,
    events,
    events_stream,
    export_batches,
    flat,
    logs,
    pipeline_events,
    pipeline_events_of,
)
from .mapping import MAPPED_SQL, flat_maps
from .registry import register
from .reports import FIVE_MINUTES, RANKED_SQL, RATES_SQL
from .search import IN_MONTH, NEWEST, TENANT

_STORED: dict[tuple[str, str], str] = {}


def stored_path(spark, sf_dir):
    """The fixture logs as a stored table, written once per session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch_path(spark, "logs")
        append_logs(logs(spark, sf_dir), path, "fixture")
        _STORED[key] = path
    return _STORED[key]


@register("scan_logs", f"SELECT {FLAT} FROM logs", (LOGS_SQL,))
def scan(spark, sf_dir):
    return flat(scan_logs(spark, stored_path(spark, sf_dir)))


@register(
    "append_logs",
    f"""SELECT CAST(make_timestamp(ts // 1000) AS DATE) AS day, tenant_id, {FLAT} FROM logs""",
    (LOGS_SQL,),
)
def append(spark, sf_dir):
    """Two loads, the first one stored twice: a repeated load replaces itself."""
    path = scratch_path(spark, "append")
    rows = logs(spark, sf_dir)
    append_logs(rows.filter(F.col("ts") < MONTH_START + 9 * DAY), path, "first")
    append_logs(rows.filter(F.col("ts") >= MONTH_START + 9 * DAY), path, "second")
    append_logs(rows.filter(F.col("ts") < MONTH_START + 9 * DAY), path, "first")
    stored = read_logs(spark, path)
    return flat(stored.withColumn("stored_day", F.col("day"))).withColumnRenamed(
        "stored_day", "day"
    )


@register(
    "replay_smaller_load",
    f"SELECT tenant_id, {FLAT} FROM logs WHERE ts >= {MONTH_START + 9 * DAY}",
    (LOGS_SQL,),
)
def replay(spark, sf_dir):
    """All rows under one load, then a replay with the later days only."""
    path, rows = scratch_path(spark, "replay"), logs(spark, sf_dir)
    append_logs(rows, path, "load")
    append_logs(rows.filter(F.col("ts") >= MONTH_START + 9 * DAY), path, "load")
    return flat(read_logs(spark, path))


@register("compact_days", f"SELECT tenant_id, {FLAT} FROM logs", (LOGS_SQL,))
def compact(spark, sf_dir):
    """Three loads of all days, rewritten as one load per day."""
    path, rows = scratch_path(spark, "compact"), logs(spark, sf_dir)
    for part in range(3):
        append_logs(rows.filter(F.pmod(F.xxhash64("span_id"), F.lit(3)) == part), path, f"load-{part}")
    compact_days(spark, path, NOW + DAY)
    return flat(read_logs(spark, path))


@register(
    "log_query_stored",
    f"""SELECT {FLAT} FROM logs WHERE {IN_MONTH} AND ts >= {NOW - 10 * DAY}
      AND service = 'svc-error' AND contains(body, 'amount 2') {NEWEST} LIMIT 100""",
    (LOGS_SQL,),
)
def log_query_stored(spark, sf_dir):
    """A search over the stored table, where whole days are skipped."""
    table = read_logs(spark, stored_path(spark, sf_dir))
    return flat(
        search.log_query(
            table, TENANT, [("service", "=", "svc-error")], [("|=", "amount 2")],
            start=NOW - 10 * DAY, now_ns=NOW,
        )
    )


@register(
    "trace_lookup_stored",
    f"""SELECT {FLAT} FROM logs WHERE tenant_id = '{TENANT}' AND trace_id = md5('77')
      ORDER BY ts, span_id, service, severity, body LIMIT 5000""",
    (LOGS_SQL,),
)
def trace_lookup_stored(spark, sf_dir):
    import hashlib

    table = read_logs(spark, stored_path(spark, sf_dir))
    return flat(search.trace_lookup(table, TENANT, hashlib.md5(b"77").hexdigest()))


@register(
    "trace_lookup_indexed",
    f"""SELECT {FLAT} FROM logs WHERE tenant_id = '{TENANT}' AND trace_id = md5('77')
      ORDER BY ts, span_id, service, severity, body""",
    (LOGS_SQL,),
)
def trace_lookup_indexed(spark, sf_dir):
    """Only the days that the index of traces names are read, of a table compacted since."""
    import hashlib

    path, rows = scratch_path(spark, "traces"), logs(spark, sf_dir)
    for part in range(2):  # the second load is left to the compaction
        append_logs(rows.where(F.pmod(F.xxhash64("span_id"), F.lit(2)) == part), path, f"eu:{part}", index=not part)
    compact_days(spark, path, NOW - 5 * DAY)
    trace = hashlib.md5(b"77").hexdigest()
    return flat(search.trace_lookup(read_trace_logs(spark, path, trace), TENANT, trace))


@register(
    "replay_odd_load_id",
    f"SELECT tenant_id, {FLAT} FROM logs WHERE ts >= {MONTH_START + 9 * DAY}",
    (LOGS_SQL,),
)
def replay_odd(spark, sf_dir):
    """A smaller replay of a load whose id has characters that folders spell otherwise,
    after its days were compacted with those of another load."""
    path, rows = scratch_path(spark, "replay-odd"), logs(spark, sf_dir)
    early = rows.where(F.col("ts") < MONTH_START + 9 * DAY)
    append_logs(rows, path, "eu:1/a=b %*")
    append_logs(early, path, "eu:1/a=b")
    compact_days(spark, path, NOW + DAY)
    append_logs(rows.where(F.col("ts") >= MONTH_START + 9 * DAY), path, "eu:1/a=b %*")
    append_logs(rows.limit(0), path, "eu:1/a=b")
    return flat(read_logs(spark, path))


LATER = NOW + 12 * DAY + DAY // 2


@register(
    "retention",
    f"SELECT tenant_id, {FLAT} FROM logs WHERE ts >= {LATER - 30 * DAY}",
    (LOGS_SQL,),
)
def retention(spark, sf_dir):
    return flat(apply_retention(read_logs(spark, stored_path(spark, sf_dir)), LATER))


@register(
    "id_width_check",
    """SELECT fits, count(*) AS rows, min(span_id) AS first_span FROM (
      SELECT span_id, event_id % 13 NOT IN (1, 2) OR (event_id % 13 = 1 AND trace_id = '') AS fits
      FROM (SELECT event_id, trace_id,
        CASE WHEN event_id % 13 = 2 THEN span_id || '€' ELSE span_id END AS span_id FROM logs))
    GROUP BY fits""",
    (LOGS_SQL,),
)
def id_width_check(spark, sf_dir):
    """Some trace ids two characters too long, some span ids three bytes (one character)."""
    rows = events(spark, sf_dir).selectExpr(
        "case when event_id % 10 = 9 then '' else concat(md5(cast(event_id div 4 as string)),"
        " case when event_id % 13 = 1 then '00' else '' end) end as trace_id",
        "concat(substring(md5(concat('s', event_id)), 1, 16),"
        " case when event_id % 13 = 2 then '€' else '' end) as span_id",
    )
    good, bad = split_bad_ids(rows)
    both = good.withColumn("fits", F.lit(True)).unionByName(bad.withColumn("fits", F.lit(False)))
    return both.groupBy("fits").agg(
        F.count(F.lit(1)).alias("rows"), F.min("span_id").alias("first_span")
    )


@register(
    "roundtrip_check",
    """SELECT count(*) AS written, count(*) AS stored, CAST(0 AS BIGINT) AS differing,
      count(CASE WHEN severity = 'INFO' THEN 1 END) AS differing_when_lost FROM logs""",
    (LOGS_SQL,),
)
def roundtrip_check(spark, sf_dir):
    """Written rows against stored ones, and, to show a hit, against a part of them."""
    rows = logs(spark, sf_dir)
    stored = read_logs(spark, stored_path(spark, sf_dir)).select(*rows.columns)
    lost = stored.filter("severity <> 'INFO'")

    def count(frame, name):
        return frame.agg(F.count(F.lit(1)).alias(name))

    return (
        count(rows, "written")
        .crossJoin(count(stored, "stored"))
        .crossJoin(count(diff_stored(rows, stored), "differing"))
        .crossJoin(count(diff_stored(rows, lost), "differing_when_lost"))
    )


@register(
    "roundtrip_check_planted",
    """SELECT span_id, body, surplus FROM (
        SELECT span_id, body, 1 AS surplus FROM logs WHERE event_id % 1000 = 7
        UNION ALL SELECT span_id, body || '!', -1 FROM logs WHERE event_id % 1000 = 7
        UNION ALL SELECT span_id, body, -2 FROM logs WHERE event_id % 1000 = 500)""",
    (LOGS_SQL,),
)
def roundtrip_planted(spark, sf_dir):
    """A stored table in which some rows were changed and some stand three times."""
    rows = logs(spark, sf_dir)
    marked = events(spark, sf_dir).select(
        F.expr("substring(md5(concat('s', event_id)), 1, 16)").alias("span_id"), (F.col("event_id") % 1000).alias("mark")
    )
    # Rows that are changed or repeated are few, and so is what is joined: all other marks change nothing.
    path = scratch_path(spark, "marks")
    marks = marked.where("span_id IS NOT NULL").groupBy("span_id").agg(F.collect_list("mark").alias("marks"))
    marks.where("size(marks) > 1 OR marks[0] IN (7, 500)").write.parquet(path)
    marks = spark.read.schema(marks.schema).parquet(path)
    stored = read_logs(spark, stored_path(spark, sf_dir)).select(*rows.columns).where("span_id IS NOT NULL")
    stored = stored.join(marks, "span_id", "left").withColumn("mark", F.explode(F.coalesce("marks", F.array(F.lit(-1).cast("bigint")))))
    changed = stored.withColumn("body", F.when(F.col("mark") == 7, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    again = F.explode(F.array_repeat("mark", F.when(F.col("mark") == 500, 3).otherwise(1)))
    planted = changed.select(*rows.columns, again.alias("again")).select(*rows.columns)
    return diff_stored(rows, planted).select("span_id", "body", F.col("surplus").cast("int").alias("surplus"))


@register("dedup", f"SELECT tenant_id, {FLAT} FROM logs", (LOGS_SQL,))
def dedup(spark, sf_dir):
    """Every row twice, and one service's rows (a fifth of all) ten times more."""
    rows = logs(spark, sf_dir)
    often = rows.filter("service = 'svc-error'").crossJoin(spark.range(10)).drop("id")
    return flat(drop_copies(rows.unionByName(rows).unionByName(often)))


# --- streams --------------------------------------------------------------------

#: Rows in one landed file, about.
ROWS_A_FILE = 200_000


def _landed(spark, sf_dir):
    path = scratch_path(spark, "landing")
    export_batches(spark, sf_dir).repartition(4, "request_id").write.parquet(path)
    return path


def _ingest(spark, sf_dir, metrics=None, streams=1):
    """Landed batches through the stream, several micro-batches; the stored table's path."""
    landed, out = _landed(spark, sf_dir), scratch_path(spark, "ingest")
    for number in range(streams):
        source = read_export_batches(spark, landed, "parquet", streaming=True, maxFilesPerTrigger=2)
        stream_ingest(
            source,
            lambda: api_keys(spark, sf_dir),
            f"{out}/logs",
            f"{out}/checkpoint-{number}",
            f"{out}/dead",
            metrics=metrics,
            now_ns=NOW,
            available_now=True,
        ).awaitTermination()
    return f"{out}/logs"


@register("stream_ingest", MAPPED_SQL, (RECORDS_SQL, KEYS_SQL))
def ingest(spark, sf_dir):
    return flat_maps(read_logs(spark, _ingest(spark, sf_dir)))


@register("two_streams_one_table", f"{MAPPED_SQL} UNION ALL {MAPPED_SQL}", (RECORDS_SQL, KEYS_SQL))
def two_streams(spark, sf_dir):
    """Two streams with equal names and own checkpoints store into one table."""
    return flat_maps(read_logs(spark, _ingest(spark, sf_dir, streams=2)))


@register(
    "batch_metrics",
    f"""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(clamped::INT) AS BIGINT) AS clamped,
      CAST(0 AS BIGINT) AS failed
    FROM records JOIN senders USING (rid)
      JOIN api_keys k ON sha256(api_key) = k.key_hash AND k.revoked_s IS NULL""",
    (RECORDS_SQL, KEYS_SQL),
)
def batch_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    _ingest(spark, sf_dir, metrics=path)
    return spark.read.parquet(path).agg(
        F.sum("rows").alias("rows"), F.sum("clamped").alias("clamped"),
        F.count("drop_reason").alias("failed"),
    )


@register(
    "stream_rejects",
    """SELECT CAST(rid AS VARCHAR) AS request_id, 'invalid_key' AS outcome FROM senders
      WHERE NOT EXISTS (SELECT 1 FROM api_keys k
        WHERE sha256(api_key) = k.key_hash AND k.revoked_s IS NULL)""",
    (RECORDS_SQL, KEYS_SQL),
)
def rejects(spark, sf_dir):
    source = read_export_batches(spark, _landed(spark, sf_dir), "parquet", streaming=True)
    out = scratch_path(spark, "rejects")
    stream_rejects(
        source, lambda: api_keys(spark, sf_dir), f"{out}/rows", f"{out}/checkpoint",
        available_now=True,
    ).awaitTermination()
    return spark.read.schema("request_id string, outcome string").parquet(f"{out}/rows").select(
        "request_id", "outcome"
    )


@register("stream_dedup", f"SELECT tenant_id, {FLAT} FROM logs", (LOGS_SQL,))
def dedup_stream(spark, sf_dir):
    """The log rows three times over in several files, so copies meet across micro-batches."""
    rows = logs(spark, sf_dir)
    copies = scratch_path(spark, "copies")
    files = max(2, -(-events(spark, sf_dir).count() // ROWS_A_FILE))
    for _ in range(3):
        rows.repartition(files, "span_id").write.mode("append").parquet(copies)
    source = (
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(copies)
    )
    out = scratch_path(spark, "dedup")
    stream_dedup(
        source, f"{out}/rows", f"{out}/seen", f"{out}/checkpoint", available_now=True
    ).awaitTermination()
    return flat(spark.read.schema(rows.schema).parquet(f"{out}/rows").drop("batch"))


def _finished(spark, stream, label):
    """Run a windowed stream over all there is and return what it emitted."""
    out = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


# In append mode a window is emitted once the watermark has passed its end.
_CLOSED = "window_end_us <= (SELECT max(at_us) // 1000 * 1000 - 60000000 FROM pipeline)"


@register(
    "stream_alert_rates",
    "SELECT * FROM ("
    + RATES_SQL.format(width=FIVE_MINUTES, starts=f"[at_us - at_us % {FIVE_MINUTES}]")
    + f") WHERE {_CLOSED}",
    (PIPELINE_SQL,),
)
def stream_alerts(spark, sf_dir):
    rows = pipeline_events_of(events_stream(spark, sf_dir))
    return _finished(spark, alert_rates(rows, watermark="1 minute"), "alerts")


@register(
    "stream_alert_flush_p99",
    f"""SELECT window_start_us, window_start_us + {FIVE_MINUTES} AS window_end_us, n, max FROM (
      SELECT at_us - at_us % {FIVE_MINUTES} AS window_start_us, count(*) AS n,
        max(flush_us) AS max FROM pipeline GROUP BY 1)
    WHERE {_CLOSED}""",
    (PIPELINE_SQL,),
)
def stream_flush_p99(spark, sf_dir):
    """The approximate p99 is left out of the comparison; tests bound its error."""
    rows = pipeline_events_of(events_stream(spark, sf_dir))
    return _finished(spark, flush_p99_approx(rows), "flush").drop("p99")


def _whole(spark, stream, label, by):
    """A windowed stream over all there is, with the windows that are still open."""
    out = scratch_path(spark, label)
    stream_windows(stream, f"{out}/rows", f"{out}/checkpoint", available_now=True).awaitTermination()
    return newest_windows(spark, f"{out}/rows", stream.schema, by)


@register(
    "stream_alert_rates_whole",
    RATES_SQL.format(width=FIVE_MINUTES, starts=f"[at_us - at_us % {FIVE_MINUTES}]"),
    (PIPELINE_SQL,),
)
def stream_alerts_whole(spark, sf_dir):
    rows = pipeline_events_of(events_stream(spark, sf_dir))
    return _whole(spark, alert_rates(rows), "alerts", ("window_start_us",))


@register(
    "stream_alert_flush_p99_whole",
    f"SELECT window_start_us, window_start_us + {FIVE_MINUTES} AS window_end_us, n, p99, max FROM ("
    + RANKED_SQL.format(group="window_start_us,", by="window_start_us")
    + ")",
    (PIPELINE_SQL,),
)
def stream_flush_p99_whole(spark, sf_dir):
    counts = flush_counts(pipeline_events_of(events_stream(spark, sf_dir)))
    return flush_p99_of_counts(_whole(spark, counts, "flush", ("window_start_us", "flush_us")))


def _partials(spark, sf_dir, label, partial, merges):
    """A stream's partial windows, merged: some while storing, the rest while reading."""
    out, events_ = scratch_path(spark, label), events_stream(spark, sf_dir)
    rows = pipeline_events_of(events_)
    # Parts as several micro-batches would leave them: by hash, so that every part is late for the others.
    for part in range(3):
        some = rows.where(F.pmod(F.xxhash64("arrived_ns"), F.lit(3)) == part)
        stream_partials(some, partial, "w.start", f"{out}/rows", f"{out}/checkpoint-{part}", available_now=True).awaitTermination()
    schema = partial(pipeline_events_of(events(spark, sf_dir))).schema
    compact_partials(spark, f"{out}/rows", schema, ["w"], merges, "9999-01-01")
    return merged(read_partials(spark, f"{out}/rows", schema), ["w"], merges)


@register(
    "stream_alert_rates_partial",
    RATES_SQL.format(width=FIVE_MINUTES, starts=f"[at_us - at_us % {FIVE_MINUTES}]"),
    (PIPELINE_SQL,),
)
def stream_alerts_partial(spark, sf_dir):
    """No watermark, no state, no window left out: partial sums in a table."""
    return rates_of_sums(_partials(spark, sf_dir, "alert-partials", alert_sums, RATE_MERGES))


@register(
    "stream_alert_flush_p99_partial",
    f"""SELECT window_start_us, window_start_us + {FIVE_MINUTES} AS window_end_us, n, max, true AS p99_within FROM (
      SELECT at_us - at_us % {FIVE_MINUTES} AS window_start_us, count(*) AS n, max(flush_us) AS max
      FROM pipeline GROUP BY 1)""",
    (PIPELINE_SQL,),
)
def stream_flush_p99_partial(spark, sf_dir):
    """Quantile sketches that merge; `p99_within` holds the p99 against the exact ranks of
    its window: no further off than 2 % of the rows, or one row."""
    found = p99_of_sketches(_partials(spark, sf_dir, "flush-partials", flush_sketches, SKETCH_MERGES))
    counts = flush_counts(pipeline_events(spark, sf_dir)).withColumnRenamed("n", "times")
    below = F.sum(F.when(F.col("flush_us") < F.col("p99"), F.col("times")).otherwise(0))
    upto = F.sum(F.when(F.col("flush_us") <= F.col("p99"), F.col("times")).otherwise(0))
    slack, wanted = F.greatest(F.lit(1.0), F.col("n") * 0.02), F.col("n") * 0.99
    within = (F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)
    return (
        found.join(counts, ["window_start_us", "window_end_us"])
        .groupBy("window_start_us", "window_end_us", "n", "max")
        .agg(below.alias("below"), upto.alias("upto"))
        .select("window_start_us", "window_end_us", "n", "max", within.alias("p99_within"))
    )
