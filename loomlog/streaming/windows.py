"""Windows of a stream, whole: open windows are kept too, and late rows still count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def stream_windows(
    windows: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Write what each micro-batch changed; `newest_windows` reads the table.

    `windows` are aggregates without watermark: no row is too late for its window,
    and the state keeps one entry per group for the life of the checkpoint. A batch
    that runs again replaces what it wrote.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = windows.writeStream.outputMode("update").foreachBatch(handle)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def newest_windows(spark: SparkSession, path: str, schema: StructType, by: tuple[str, ...]) -> DataFrame:
    """The last value of each group that `stream_windows` has written."""
    stored = StructType([*schema.fields, StructField("batch", LongType())])
    last = F.max_by(F.struct(*schema.names), "batch").alias("last")
    return spark.read.schema(stored).parquet(path).groupBy(*by).agg(last).select("last.*")
