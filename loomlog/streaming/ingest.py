"""Continuous ingest: landed export batches to the stored log table."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import routing
from ..operators.mapping import map_resolved, with_record_count
from ..operators.tenants import asked_keys, live_keys, lookup, resolve_tenant, with_key_hash
from ..schema import LOGS
from ..session import configure
from ..sources.files import delete, folders
from ..sources.logs import append_logs

LOG = logging.getLogger(__name__)

# Attempts per flush, seconds between them, usual flush interval.
FLUSH_ATTEMPTS = 3
RETRY_SECONDS = 0.05
FLUSH_INTERVAL = "200 milliseconds"
LIVE_KEYS = "key_hash string, tenant_id string, revoked_at timestamp"

KeyLoader = Callable[[], DataFrame]
Writer = Callable[[DataFrame, str, str], None]


def _start(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool,
    interval: str,
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def stream_ingest(
    requests: DataFrame,
    load_keys: KeyLoader,
    path: str,
    checkpoint: str,
    dead_letters: str,
    metrics: str | None = None,
    rejects: str | None = None,
    now_ns: int | None = None,
    name: str = "stream",
    available_now: bool = False,
    interval: str = FLUSH_INTERVAL,
    write: Writer = append_logs,
) -> StreamingQuery:
    """Start the ingest of a stream of export batches.

    Keys are loaded for every micro-batch, so issue and revocation take effect
    with the next one. A micro-batch is stored under its own load id, made of
    `name`, the query's own id (which lives in the checkpoint) and the batch
    number: several streams can feed one table, and a batch that runs again after
    a crash replaces what it wrote before. `now_ns`
    fixes the clock (for tests); otherwise each request's arrival time is used.
    With `rejects`, all rules for requests apply (content type, key, body size,
    readability, number of records), and those refused are written there with
    their outcome. The keys of a micro-batch are then kept with it: one decision
    for both outputs, also when the batch runs again after a key has changed. They go
    when the next micro-batch has been stored.
    Batch size is the source's business: set `maxFilesPerTrigger` or
    `maxBytesPerTrigger` when reading.
    """
    configure(requests.sparkSession)
    handled: list[str] = []  # by this process; only its first micro-batch can have run before

    def handle(batch: DataFrame, batch_id: int) -> None:
        load_id = f"{name}-{query_id(batch, checkpoint)}-{batch_id:012d}"
        if rejects:
            keys = _keys_of_batch(batch, load_keys, f"{rejects}/_keys/load_id={load_id}")
            routed = routing.route_requests(with_record_count(batch), asked_keys(keys, batch))
            refused = routing.dead_letters(routed).select("request_id", "outcome", "status", "arrived_ns")
            refused.write.mode("overwrite").parquet(f"{rejects}/load_id={load_id}")
            known = routing.accepted(routed)
        else:
            known = resolve_tenant(batch, asked_keys(load_keys(), batch))
        now = F.col("arrived_ns") if now_ns is None else now_ns
        rows = map_resolved(known, now, clamped=True)
        counts = _flush(rows, path, load_id, dead_letters, write, fresh=bool(handled))
        if metrics:
            _record(batch, f"{metrics}/load_id={load_id}", counts)
        if rejects and handled:  # Spark has committed the batch before this one
            delete(batch.sparkSession, f"{rejects}/_keys/load_id={handled.pop()}")
        handled[:] = [load_id]

    return _start(requests, handle, checkpoint, available_now, interval)


def _keys_of_batch(batch: DataFrame, load_keys: KeyLoader, path: str) -> DataFrame:
    """The keys as they were when the micro-batch first ran."""
    spark = batch.sparkSession
    if not folders(spark, f"{path}/_SUCCESS"):
        live_keys(load_keys()).withColumn("revoked_at", F.lit(None).cast("timestamp")).write.mode("overwrite").parquet(path)
    return spark.read.schema(LIVE_KEYS).parquet(path)


def query_id(batch: DataFrame, checkpoint: str) -> str:
    """The id of the streaming query that has this checkpoint, the same after a restart."""
    text = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]
    return json.loads(text)["id"]


def _flush(
    rows: DataFrame, path: str, load_id: str, dead_letters: str, write: Writer, fresh: bool
) -> dict[str, int]:
    """Store one micro-batch: a few attempts, then the dead-letter table.

    The usual writer is told what cannot have been stored before, and leaves the index of
    traces to the compaction of the day.

    Rows are never dropped. If the dead-letter table cannot be written either,
    the error ends the stream, and the batch runs again at the next start.
    """
    for attempt in range(1, FLUSH_ATTEMPTS + 1):
        seen = Observation()
        observed = observe_rows(rows, seen).select(*LOGS.names)
        began = time.monotonic()
        try:
            if write is append_logs:
                append_logs(observed, path, load_id, fresh=fresh and attempt == 1, index=False)
            else:
                write(observed, path, load_id)
            return _counts(seen, began, None)
        except Exception:
            LOG.exception("flush of %s failed (attempt %d)", load_id, attempt)
            if attempt < FLUSH_ATTEMPTS:
                time.sleep(RETRY_SECONDS)
    seen = Observation()
    began = time.monotonic()
    observed = observe_rows(rows, seen).select(*LOGS.names)
    observed.write.mode("overwrite").parquet(f"{dead_letters}/load_id={load_id}")
    return _counts(seen, began, "flush_error")


def observe_rows(rows: DataFrame, observation: Observation) -> DataFrame:
    """Count rows and rejected stamps while the rows pass by, without a second pass."""
    return rows.observe(
        observation,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.col("clamped").cast("bigint")), F.lit(0)).alias("clamped"),
    )


def _counts(seen: Observation, began: float, drop_reason: str | None) -> dict:
    return {
        **seen.get,
        "flush_us": int((time.monotonic() - began) * 1e6),
        "drop_reason": drop_reason,
    }


def _record(batch: DataFrame, path: str, counts: dict) -> None:
    """One row per micro-batch, in the form the reports and alerts read."""
    row = (
        datetime.now(),
        counts["rows"],
        counts["clamped"],
        counts["flush_us"],
        counts["drop_reason"],
    )
    schema = "at timestamp, rows bigint, clamped bigint, flush_us bigint, drop_reason string"
    frame = batch.sparkSession.createDataFrame([row], schema)
    frame.coalesce(1).write.mode("overwrite").parquet(path)


def stream_rejects(
    requests: DataFrame,
    load_keys: KeyLoader,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    interval: str = FLUSH_INTERVAL,
) -> StreamingQuery:
    """Start the record of refused requests: unreadable, or no live key.

    A stream of its own, so it reads only the small header columns.
    """
    headers = requests.select(
        "request_id", "x_api_key", "authorization", "readable", "arrived_ns"
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        found = lookup(with_key_hash(batch), asked_keys(load_keys(), batch), "left")
        outcome = (
            F.when(~F.col("readable"), "unreadable_body")
            .when(F.col("key_hash").isNull(), "missing_key")
            .when(F.col("tenant_id").isNull(), "invalid_key")
        )
        refused = found.select("request_id", outcome.alias("outcome"), "arrived_ns")
        refused = refused.filter(F.col("outcome").isNotNull())
        load_id = f"rejects-{query_id(batch, checkpoint)}-{batch_id:012d}"
        refused.write.mode("overwrite").parquet(f"{path}/load_id={load_id}")

    return _start(headers, handle, checkpoint, available_now, interval)
