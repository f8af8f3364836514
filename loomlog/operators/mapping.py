"""Export batches (nested) to log rows (flat)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mapping as rules
from ..schema import LOGS
from ..session import configure
from .tenants import resolve_tenant


def _resources(batches: DataFrame, *keep: str) -> DataFrame:
    """One row per scope: its records, and the attributes of its resource.

    The attributes are a ready map where all are text, and the raw list
    otherwise. Nothing here is interpreted, so no record list is copied.
    """
    configure(batches.sparkSession)
    pairs = "rl.resource.attributes"
    scopes = (
        batches.select(*keep, F.explode("resource_logs").alias("rl"))
        .select("*", F.explode("rl.scope_logs.log_records").alias("records"))
        .select(
            *keep,
            "records",
            F.col(pairs).alias("pairs"),
            rules.all_text_col(pairs).alias("all_text"),
            rules.sorted_pairs_col(pairs).alias("sorted_pairs"),
        )
    )
    return scopes.select(*keep, "records", *_split_map("resource"))


def _split_map(name: str) -> list[Column]:
    """`<name>_text`, the map of a list of text values, and `<name>_mixed`, any other list."""
    return [
        F.when(F.col("all_text"), rules.text_map_col("sorted_pairs")).alias(f"{name}_text"),
        F.when(~F.col("all_text"), F.col("pairs")).alias(f"{name}_mixed"),
    ]


def _joined_map(name: str) -> Column:
    mixed = f"{name}_mixed"
    return F.coalesce(
        F.col(f"{name}_text"),
        F.when(F.col(mixed).isNotNull(), rules.mixed_map_col(mixed)),
        rules.empty_map_col(),
    )


def explode_records(batches: DataFrame, *keep: str) -> DataFrame:
    """One row per record, with its resource map and service carried along.

    `keep` names request columns to carry.
    """
    resource = _joined_map("resource")
    return _resources(batches, *keep).select(
        *keep,
        resource.alias("resource"),
        rules.service_col(resource).alias("service"),
        F.explode("records").alias("record"),
    )


def with_record_count(batches: DataFrame) -> DataFrame:
    """Adds `record_count` per request without building a row per record."""
    def total(sizes: Column) -> Column:
        return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, n: a + n)

    def in_resource(resource: Column) -> Column:
        sizes = F.transform(
            resource["scope_logs"],
            lambda s: F.coalesce(F.array_size(s["log_records"]), F.lit(0)).cast("bigint"),
        )
        return F.coalesce(total(sizes), F.lit(0).cast("bigint"))

    counts = F.transform("resource_logs", in_resource)
    return batches.withColumn(
        "record_count", F.coalesce(total(counts), F.lit(0).cast("bigint"))
    )


def map_resolved(
    batches: DataFrame, now_ns: Column | int, clamped: bool = False
) -> DataFrame:
    """Rows of batches that already carry their `tenant_id`.

    `now_ns` is one number for the run, or the request column that holds the
    arrival time. With `clamped` a flag tells whether the record's own stamp
    was rejected.

    Done in two steps that Spark keeps apart: everything that is generated
    code happens while records unfold, and what must be interpreted (values
    that are not text) happens last, on the few columns that need it.
    """
    keep = ["tenant_id"]
    if not isinstance(now_ns, int):
        batches = batches.select("tenant_id", "resource_logs", now_ns.alias("arrived_ns"))
        now_ns = F.col("arrived_ns")
        keep.append("arrived_ns")
    records = _resources(batches, *keep).select(
        *keep, "resource_text", "resource_mixed", F.explode("records").alias("record")
    )
    time = F.col("record.time_unix_nano")
    pairs, body = "record.attributes", "record.body"
    # Doubles and nested values, the kinds whose text needs interpreted rules.
    other_kind = F.expr(f"{body}.double_value is not null or {body}.json_value is not null")
    unfolded = records.select(
        "tenant_id",
        rules.event_time_col(time, F.col("record.observed_time_unix_nano"), now_ns).alias("ts"),
        rules.severity_col(
            F.col("record.severity_number"), F.col("record.severity_text")
        ).alias("severity"),
        rules.hex_id_col(F.col("record.trace_id"), 16).alias("trace_id"),
        rules.hex_id_col(F.col("record.span_id"), 8).alias("span_id"),
        rules.simple_text_col(body).alias("body_text"),
        F.when(other_kind, F.col(body)).alias("body_other"),
        "resource_text",
        "resource_mixed",
        F.col(pairs).alias("pairs"),
        rules.all_text_col(pairs).alias("all_text"),
        rules.sorted_pairs_col(pairs).alias("sorted_pairs"),
        *([rules.clamped_col(time, now_ns).alias("clamped")] if clamped else []),
    )
    kept = [c for c in unfolded.columns if c not in ("pairs", "all_text", "sorted_pairs")]
    split = unfolded.select(*kept, *_split_map("attrs"))
    other = "body_other"
    resource = _joined_map("resource")
    finished = {
        "service": rules.service_col(resource),
        "body": F.coalesce(
            F.col("body_text"), F.when(F.col(other).isNotNull(), rules.any_value_col(other)), F.lit("")
        ),
        "attrs": _joined_map("attrs"),
        "resource": resource,
    }
    out = [finished.get(name, F.col(name)).alias(name) for name in LOGS.names]
    return split.select(*out, *(["clamped"] if clamped else []))


def map_batches(batches: DataFrame, keys: DataFrame, now_ns: Column | int) -> DataFrame:
    """Batches to log rows; the tenant comes from the request key, never the payload."""
    return map_resolved(resolve_tenant(batches, keys), now_ns)
