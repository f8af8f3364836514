"""Landed export batches: JSON lines (the standard's own, or flat) or Parquet files,
as table or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LANDED_BATCHES
from ..session import configure
from .standard import STANDARD_BATCHES, as_export_batches

_CORRUPT = "_corrupt_record"


def read_export_batches(
    spark: SparkSession,
    path: str,
    file_format: str = "json",
    streaming: bool = False,
    **options: str | int,
) -> DataFrame:
    """Requests with `readable` and `arrived_ns` added.

    `file_format` "otlp_json" is the standard export JSON, one request a line, with typed
    values nested to any depth; "json" and "parquet" have the columns of `EXPORT_BATCHES`.
    What the receiver knows of a request (its id, headers, size) stands beside the payload.

    `arrived_ns`, the landing time of the file, stands for `now` of the request:
    unlike a clock, it is the same when a failed micro-batch is read again.
    """
    if file_format not in ("otlp_json", "json", "parquet"):
        raise ValueError(f"file_format must be 'otlp_json', 'json' or 'parquet', not {file_format!r}")
    reader = configure(spark).readStream if streaming else configure(spark).read
    standard, file_format = file_format == "otlp_json", file_format.removeprefix("otlp_")
    schema = STANDARD_BATCHES if standard else LANDED_BATCHES
    if file_format == "json":
        # A line that is not valid JSON keeps its text here instead of failing the job.
        schema = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", _CORRUPT)
    raw = reader.format(file_format).schema(schema).options(**options).load(path)
    readable = F.col(_CORRUPT).isNull() if file_format == "json" else F.lit(True)
    arrived = F.unix_micros("_metadata.file_modification_time") * 1000
    landed = raw.select(*[c for c in schema.names if c != _CORRUPT], readable.alias("readable"), arrived.alias("arrived_ns"))
    if standard:
        landed = as_export_batches(landed)
    return landed.select(*LANDED_BATCHES.names, "readable", "arrived_ns")
