"""Export batches to log rows, rule by rule and as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.functions import mapping as rules
from loomlog.operators.checks import normalize_time as split_times
from loomlog.operators.mapping import explode_records, map_batches, with_record_count
from loomlog.session import scratch_path
from loomlog.sources.export import read_export_batches

from .fixtures import (
    typed,
    typed_list,
    typed_map,
    ATTRS_TEXT_SQL,
    KEYS_SQL,
    NOW,
    RECORDS_SQL,
    TYPED_TREE,
    api_keys,
    events,
    export_batches,
    map_text,
    raw_records,
    standard_exports,
)
from .registry import register

RECORDS = (RECORDS_SQL,)


def _span():
    return F.lower(F.hex("record.span_id")).alias("span_id")


@register(
    "explode_records",
    """SELECT CAST(rid AS VARCHAR) AS request_id, span_id, service, own AS time_unix_nano,
      severity_number, severity_text FROM records""",
    RECORDS,
)
def explode(spark, sf_dir):
    rows = explode_records(export_batches(spark, sf_dir), "request_id")
    return rows.select(
        "request_id", _span(), "service",
        "record.time_unix_nano", "record.severity_number", "record.severity_text",
    )


@register(
    "record_count",
    "SELECT CAST(rid AS VARCHAR) AS request_id, count(*) AS record_count FROM records GROUP BY rid",
    RECORDS,
)
def record_count(spark, sf_dir):
    return with_record_count(export_batches(spark, sf_dir)).select("request_id", "record_count")


@register("map_severity", "SELECT event_id, severity FROM records", RECORDS)
def map_severity(spark, sf_dir):
    severity = rules.severity_col(F.col("severity_number"), F.col("severity_text"))
    return raw_records(spark, sf_dir).select("event_id", severity.alias("severity"))


@register("resolve_event_time", "SELECT event_id, ts FROM records", RECORDS)
def resolve_event_time(spark, sf_dir):
    ts = rules.event_time_col(F.col("time_unix_nano"), F.col("observed_time_unix_nano"), NOW)
    return raw_records(spark, sf_dir).select("event_id", ts.alias("ts"))


@register(
    "ts_clamped",
    """SELECT event_type, count(*) AS rows, CAST(sum(clamped::INT) AS BIGINT) AS clamped
      FROM records GROUP BY event_type""",
    RECORDS,
)
def ts_clamped(spark, sf_dir):
    clamped = rules.clamped_col(F.col("time_unix_nano"), NOW).cast("bigint")
    return (
        raw_records(spark, sf_dir)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(clamped).alias("clamped"))
    )


@register("hex_ids", "SELECT event_id, trace_id, span_id FROM records", RECORDS)
def hex_ids(spark, sf_dir):
    return raw_records(spark, sf_dir).select(
        "event_id",
        rules.hex_id_col(F.col("trace_id"), 16).alias("trace_id"),
        rules.hex_id_col(F.col("span_id"), 8).alias("span_id"),
    )


@register(
    "service_name",
    """SELECT span_id, service, 'host=' || rid
      || CASE WHEN service = 'unknown' THEN '' ELSE ';service.name=' || service END AS resource
      FROM records""",
    RECORDS,
)
def service_name(spark, sf_dir):
    rows = explode_records(export_batches(spark, sf_dir))
    return rows.select(_span(), "service", map_text("resource").alias("resource"))


@register("flatten_attrs", f"SELECT event_id, {ATTRS_TEXT_SQL} AS attrs FROM records", RECORDS)
def flatten_attrs(spark, sf_dir):
    rows = raw_records(spark, sf_dir)
    flat = rows.select("event_id", rules.flatten_kvs_col("attributes").alias("attrs"))
    return flat.select("event_id", map_text("attrs").alias("attrs"))


@register("stringify_value", "SELECT event_id, body FROM records", RECORDS)
def stringify_value(spark, sf_dir):
    return raw_records(spark, sf_dir).select(
        "event_id", rules.any_value_col("body").alias("body")
    )


@register(
    "stringify_nested",
    r"""SELECT event_id, '{"a":[' || user_id || ',"x, \"1.0\" {",null,true],"k":"last","é":'
      || '{"n":1.0,"z":-2.50}}' AS text FROM records""",
    RECORDS,
)
def stringify_nested(spark, sf_dir):
    text = F.expr(
        """concat('{ "k": "first", "é": {"z": -2.50, "n": 1.0}, "a": [', user_id, """
        """', "x, \\\\"1.0\\\\" {", null, true ], "k": "last" }')"""
    )
    rows = raw_records(spark, sf_dir).select("event_id", text.alias("json"))
    return rows.select("event_id", rules.nested_text_col("json").alias("text"))


MAPPED_SQL = f"""SELECT k.tenant_id, r.ts, r.severity, r.service, r.trace_id, r.span_id, r.body,
    {ATTRS_TEXT_SQL} AS attrs,
    'host=' || r.rid || CASE WHEN r.service = 'unknown' THEN ''
      ELSE ';service.name=' || r.service END AS resource
  FROM records r JOIN senders s USING (rid)
    JOIN api_keys k ON sha256(s.api_key) = k.key_hash AND k.revoked_s IS NULL"""


def flat_maps(rows):
    return rows.select(
        "tenant_id", "ts", "severity", "service", "trace_id", "span_id", "body",
        map_text("attrs").alias("attrs"), map_text("resource").alias("resource"),
    )


@register("map_export_batches", MAPPED_SQL, (RECORDS_SQL, KEYS_SQL))
def map_export_batches(spark, sf_dir):
    batches, keys = export_batches(spark, sf_dir), api_keys(spark, sf_dir)
    return flat_maps(map_batches(batches, keys, NOW))


@register(
    "read_export_batches",
    """SELECT CAST(rid AS VARCHAR) AS request_id, CASE WHEN rid % 3 <> 0 THEN api_key END
        AS x_api_key, CASE WHEN rid % 3 = 0 THEN 'Bearer ' || api_key END AS "authorization",
      count(*) AS record_count, true AS readable
      FROM records JOIN senders USING (rid) GROUP BY rid, api_key""",
    RECORDS,
)
def read_batches(spark, sf_dir):
    path = scratch_path(spark, "landing-json")
    export_batches(spark, sf_dir).write.json(path)
    landed = with_record_count(read_export_batches(spark, path))
    return landed.select("request_id", "x_api_key", "authorization", "record_count", "readable")


def landed_standard(spark, sf_dir):
    path = scratch_path(spark, "landing-standard")
    standard_exports(spark, sf_dir).write.text(path)
    return read_export_batches(spark, path, "otlp_json")


@register(
    "read_export_standard",
    """SELECT CAST(rid AS VARCHAR) AS request_id, CASE WHEN rid % 3 <> 0 THEN api_key END
        AS x_api_key, CASE WHEN rid % 3 = 0 THEN 'Bearer ' || api_key END AS "authorization",
      count(*) AS record_count, true AS readable
      FROM records JOIN senders USING (rid) GROUP BY rid, api_key""",
    RECORDS,
)
def read_standard(spark, sf_dir):
    landed = with_record_count(landed_standard(spark, sf_dir))
    return landed.select("request_id", "x_api_key", "authorization", "record_count", "readable")


@register("map_export_standard", MAPPED_SQL, (RECORDS_SQL, KEYS_SQL))
def map_standard(spark, sf_dir):
    """From the standard's own JSON, with typed values nested in lists and maps."""
    return flat_maps(map_batches(landed_standard(spark, sf_dir), api_keys(spark, sf_dir), NOW))


@register(
    "stringify_nested_trees",
    """SELECT 's' || event_id AS span_id,
      '[{"b":null,"z":[1,"x",2.0]},"' || event_type || '\\n\\"",[[[' || user_id || ',true,"dead",null]],{}],null,[]]' AS text
      FROM records""",
    RECORDS,
)
def stringify_trees(spark, sf_dir):
    """Lists and maps inside one another, from typed trees read as standard JSON."""
    inner = typed_list(
        typed("intValue", "cast(user_id as string)"), typed("boolValue", "true"),
        typed("bytesValue", "'3q0='"), typed("doubleValue", "'NaN'"),
    )
    tree = typed_list(
        TYPED_TREE, typed("stringValue", "concat(event_type, chr(10), chr(34))"),
        typed_list(typed_list(inner), typed_map("cast(null as string)")), "'{}'", typed_list("cast(null as string)"),
    )
    line = f"""concat('{{"resourceLogs":[{{"scopeLogs":[{{"logRecords":[{{"severityText":"s', event_id, '","body":', {tree}, '}}]}}]}}]}}')"""
    path = scratch_path(spark, "landing-trees")
    events(spark, sf_dir).selectExpr(f"{line} as value").write.text(path)
    records = explode_records(read_export_batches(spark, path, "otlp_json"))
    return records.select(
        F.col("record.severity_text").alias("span_id"), rules.any_value_col("record.body").alias("text")
    )


@register(
    "normalize_time",
    """SELECT event_id, CASE event_id % 8
        WHEN 0 THEN CAST(epoch_us(ts) // 1000000 AS BIGINT) * 1000000000
        WHEN 1 THEN epoch_us(ts) * 1000
        WHEN 2 THEN CAST(epoch_us(ts) // 1000000 AS BIGINT) * 1000000000 + 500000000
        WHEN 3 THEN epoch_us(ts) * 1000 + 789
        WHEN 4 THEN (epoch_us(ts) // 1000000) * 1000000000 - 19800000000000
        WHEN 5 THEN -(event_id * 1000000000) END AS ns,
      event_id % 8 >= 6 AS bad FROM events""",
)
def normalize_time(spark, sf_dir):
    text = F.expr(
        "case event_id % 8 when 0 then cast(unix_seconds(cast(ts as timestamp)) as string)"
        " when 1 then cast(unix_micros(cast(ts as timestamp)) * 1000 as string)"
        " when 2 then concat(unix_seconds(cast(ts as timestamp)), '.5')"
        " when 3 then concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '789Z')"
        " when 4 then concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+05:30')"
        " when 5 then concat('-', event_id)"
        " when 6 then concat(event_type, '.', event_id)"
        " else concat('2024-02-31T00:00:00Z', substring('x', 1, event_id % 2)) end"
    )
    rows = events(spark, sf_dir).select("event_id", text.alias("when"))
    good, bad = split_times(rows, "when")
    return good.select("event_id", "ns", F.lit(False).alias("bad")).unionByName(
        bad.select("event_id", F.lit(None).cast("bigint").alias("ns"), F.lit(True).alias("bad"))
    )
