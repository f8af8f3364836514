"""Windows of a stream without streaming state: partial aggregates kept in a table.

Each micro-batch is aggregated by itself, and its partial results, one row per window
and group, are stored; a reader merges the partials of a window. So a row counts
however late it comes, nothing waits for a watermark, and what the stream remembers
is only its place in the source. `compact_partials` merges the stored partials of
past days, so a day ends as one row per window and group.

Anything whose partial results can be merged fits: sums and counts by a sum, extremes
by an extreme, quantile sketches by their merge.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.files import delete, folders, move, read_text, write_text
from .ingest import query_id

#: Where a day's merged copy is staged, the list of what it holds, and its own name.
STAGED, HELD, MERGED = "_merging", "_HELD", "merged"


def stream_partials(
    events: DataFrame,
    partial: Callable[[DataFrame], DataFrame],
    start: str,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Store `partial` of each micro-batch by the day of its window's `start` (a timestamp).

    A micro-batch that runs again writes the same rows to the same folders.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = partial(batch).withColumns(
            {"day": F.to_date(start), "batch": F.lit(f"{query_id(batch, checkpoint)}-{batch_id:012d}")}
        )
        _write(rows, path, ("day", "batch"))

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def _write(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    few = rows.hint("rebalance", *by)
    few.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_partials(
    spark: SparkSession, path: str, schema: StructType, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """Stored partials, of all days or of some: only these are listed."""
    days = [
        p for p in folders(spark, f"{path}/day=*")
        if (first_day is None or p.rpartition("day=")[2] >= first_day)
        and (last_day is None or p.rpartition("day=")[2] <= last_day)
    ]
    batches = [b for day in days for b in folders(spark, f"{day}/batch=*")]
    return spark.read.schema(schema).parquet(*batches) if batches else spark.createDataFrame([], schema)


def merged(partials: DataFrame, by: Sequence[str], merges: dict[str, Callable[[str], Column]]) -> DataFrame:
    """One row per group, each column merged by its rule."""
    return partials.groupBy(*by).agg(*[rule(name).alias(name) for name, rule in merges.items()])


def compact_partials(
    spark: SparkSession,
    path: str,
    schema: StructType,
    by: Sequence[str],
    merges: dict[str, Callable[[str], Column]],
    before_day: str,
) -> list[str]:
    """Merge the partials of each day before `before_day` that has more than one part.

    The newest micro-batch of every query stays as it is, since it alone can run again.
    A merged copy is staged with the list of parts it holds, which completes it; then
    these go and it takes their place. A call that stopped is finished by the next.
    """
    done = {_finish(spark, path, p.rpartition("day=")[2].partition("/")[0]) for p in folders(spark, f"{path}/{STAGED}/day=*/{HELD}")}
    newest: dict[str, str] = {}
    for batch in folders(spark, f"{path}/day=*/batch=*"):
        query, _, number = batch.rpartition("batch=")[2].rpartition("-")
        newest[query] = max(newest.get(query, ""), number)
    kept = {f"{query}-{number}" for query, number in newest.items() if query}
    for folder in folders(spark, f"{path}/day=*"):
        day = folder.rpartition("day=")[2]
        parts = [p for p in folders(spark, f"{folder}/batch=*") if p.rpartition("batch=")[2] not in kept]
        if day >= before_day or len(parts) < 2:
            continue
        staged = f"{path}/{STAGED}/day={day}"
        _write(merged(spark.read.schema(schema).parquet(*parts), by, merges).select(*schema.names), staged)
        write_text(spark, f"{staged}/{HELD}", json.dumps([p.rpartition("batch=")[2] for p in parts]))
        done.add(_finish(spark, path, day))
    return sorted(done)


def _finish(spark: SparkSession, path: str, day: str) -> str:
    staged, folder = f"{path}/{STAGED}/day={day}", f"{path}/day={day}"
    for part in json.loads(read_text(spark, f"{staged}/{HELD}")):
        delete(spark, f"{folder}/batch={part}")
    move(spark, staged, f"{folder}/batch={MERGED}")
    return day
