"""Removal of repeated rows from a stream, e.g. after a sender's retry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import day_col
from ..operators.dedup import dedup, fingerprint_col
from ..sources.files import delete, folders
from .ingest import query_id


def seen_folders(spark: SparkSession, seen_path: str, days: Sequence[str], own: str) -> list[str]:
    """Folders of the fingerprints of some days, but what an earlier attempt of the
    micro-batch `own` has left."""
    found = [p for day in days for p in folders(spark, f"{seen_path}/day={day}/batch=*")]
    return [p for p in found if not p.endswith(own)]


def _unseen(rows: DataFrame, known: list[str]) -> DataFrame:
    if not known:
        return rows
    seen = rows.sparkSession.read.schema("fingerprint string").parquet(*known).distinct()
    return rows.join(seen, "fingerprint", "left_anti")


def stream_dedup(
    rows: DataFrame,
    path: str,
    seen_path: str,
    checkpoint: str,
    horizon: int | None = None,
    available_now: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Start a stream that stores each row once.

    Equal rows have equal stamps: fingerprints are kept by day, and a micro-batch asks
    only those of its own rows' days, also of other streams that share the table. So what
    it reads follows the days that still get rows, not the age of the table. Rows without
    a stamp (no column `ts`) ask the whole table. With a `horizon`, a row is stored once
    among so many last micro-batches of this query: only their fingerprints are read and
    older ones are deleted.

    Copies inside a micro-batch collapse on the map side, so one row repeated
    without end is no hot key. What is left, one row per fingerprint, is
    checked against a narrow table of recent fingerprints. Late rows are kept:
    there is no watermark to fall behind. Both outputs are stored per
    micro-batch, so a batch that runs again replaces its own output.
    """
    session = rows.sparkSession
    by_day = horizon is None and "ts" in rows.columns

    def handle(batch: DataFrame, batch_id: int) -> None:
        single = dedup(batch)
        fresh = single.withColumn("fingerprint", fingerprint_col(single))
        own = f"batch={query_id(batch, checkpoint)}-"
        name = f"{own}{batch_id:012d}"
        if by_day:
            days = [r["day"].isoformat() for r in batch.select(day_col(F.col("ts")).alias("day")).distinct().collect()]
            fresh = _unseen(fresh, seen_folders(session, seen_path, days, name))
            fresh.drop("fingerprint").write.mode("overwrite").parquet(f"{path}/{name}")
            stored = session.read.schema(batch.schema).parquet(f"{path}/{name}")
            marks = stored.select(
                fingerprint_col(stored).alias("fingerprint"), day_col(F.col("ts")).alias("day"), F.lit(name[6:]).alias("batch")
            )
            marks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(seen_path)
            return
        known = [p for p in folders(session, f"{seen_path}/batch=*") if not p.endswith(name)]
        if horizon is not None:
            first = f"{own}{max(0, batch_id - horizon):012d}"
            mine = [p for p in known if f"/{own}" in p and p.rpartition("/")[2] < name]
            known = [p for p in mine if p.rpartition("/")[2] >= first]
            for folder in sorted(set(mine) - set(known)):
                delete(session, folder)
        fresh = _unseen(fresh, known)
        fresh.drop("fingerprint").write.mode("overwrite").parquet(f"{path}/{name}")
        # Read back what was stored, so that both outputs hold the same rows.
        stored = session.read.schema(batch.schema).parquet(f"{path}/{name}")
        stored.select(fingerprint_col(stored).alias("fingerprint")).write.mode(
            "overwrite"
        ).parquet(f"{seen_path}/{name}")

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
