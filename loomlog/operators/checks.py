"""Data-quality checks: id widths, stored against written, tenant isolation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import nanos_col
from .dedup import fingerprint_col
from .filters import scope

# Widest ids in bytes.
TRACE_ID_BYTES = 32
SPAN_ID_BYTES = 16


def split_bad_ids(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ids fit, and rows to quarantine: a wide id is never cut."""
    wide = (F.octet_length("trace_id") > TRACE_ID_BYTES) | (
        F.octet_length("span_id") > SPAN_ID_BYTES
    )
    return rows.filter(~wide), rows.filter(wide)


def normalize_time(
    rows: DataFrame, column: str, json_number: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows with their time text as `ns`, and rows whose text is no time."""
    timed = rows.withColumn("ns", nanos_col(F.col(column), json_number))
    return timed.filter(F.col("ns").isNotNull()), timed.filter(F.col("ns").isNull()).drop("ns")


def isolation_violations(logs: DataFrame, tenant: str, results: DataFrame) -> DataFrame:
    """Rows of a search result that are not rows of the tenant that searched.

    Rows are told apart by all their columns. A row the tenant has, but fewer times
    than it was returned, is reported as well, and so is one found in no table;
    `surplus` is how often too often. Only the tenant's rows are read, and only the
    fingerprints of rows that were returned are counted.
    """
    columns = results.columns
    own = scope(logs, tenant).select(*columns)
    returned = (
        results.withColumn("fingerprint", fingerprint_col(results))
        .groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("returned"), F.first(F.struct(*columns)).alias("row"))
    )
    stored = (
        own.select(fingerprint_col(own).alias("fingerprint"))
        .join(returned.select("fingerprint"), "fingerprint", "left_semi")
        .groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("stored"))
    )
    surplus = F.col("returned") - F.coalesce("stored", F.lit(0))
    found = returned.join(stored, "fingerprint", "left").withColumn("surplus", surplus)
    return found.filter("surplus > 0").select("row.*", "surplus")
