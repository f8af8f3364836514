"""Declared schemas. Nothing in this package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING_MAP = T.MapType(T.StringType(), T.StringType(), False)

# One stored log row. `ts` is epoch nanoseconds: Spark timestamps stop at microseconds.
LOGS = T.StructType(
    [
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("trace_id", T.StringType(), False),
        T.StructField("span_id", T.StringType(), False),
        T.StructField("body", T.StringType(), False),
        T.StructField("attrs", _STRING_MAP, False),
        T.StructField("resource", _STRING_MAP, False),
    ]
)

# Directory columns of the stored table, in nesting order.
PARTITION_COLUMNS = ("day", "load_id")

STORED_LOGS = T.StructType(
    LOGS.fields
    + [
        T.StructField("day", T.DateType(), False),
        T.StructField("load_id", T.StringType(), False),
    ]
)

# What a search returns: the tenant is never part of the result.
RESULT_COLUMNS = ("ts", "severity", "service", "trace_id", "span_id", "body", "attrs", "resource")

API_KEYS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("key_hash", T.StringType(), False),
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("revoked_at", T.TimestampType(), True),
    ]
)

# Attribute value: at most one field is set. Lists and key/value lists, which
# nest without bound, arrive as JSON text in `json_value`.
ANY_VALUE = T.StructType(
    [
        T.StructField("string_value", T.StringType()),
        T.StructField("bool_value", T.BooleanType()),
        T.StructField("int_value", T.LongType()),
        T.StructField("double_value", T.DoubleType()),
        T.StructField("bytes_value", T.BinaryType()),
        T.StructField("json_value", T.StringType()),
    ]
)

KEY_VALUES = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", ANY_VALUE)])
)

LOG_RECORD = T.StructType(
    [
        T.StructField("time_unix_nano", T.LongType()),
        T.StructField("observed_time_unix_nano", T.LongType()),
        T.StructField("severity_number", T.IntegerType()),
        T.StructField("severity_text", T.StringType()),
        T.StructField("trace_id", T.BinaryType()),
        T.StructField("span_id", T.BinaryType()),
        T.StructField("body", ANY_VALUE),
        T.StructField("attributes", KEY_VALUES),
    ]
)

RESOURCE_LOGS = T.ArrayType(
    T.StructType(
        [
            T.StructField("resource", T.StructType([T.StructField("attributes", KEY_VALUES)])),
            T.StructField(
                "scope_logs",
                T.ArrayType(T.StructType([T.StructField("log_records", T.ArrayType(LOG_RECORD))])),
            ),
        ]
    )
)

# One export request as it lands: who sent it (headers) and the nested payload.
EXPORT_BATCHES = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("x_api_key", T.StringType()),
        T.StructField("authorization", T.StringType()),
        T.StructField("resource_logs", RESOURCE_LOGS),
    ]
)

# As they land, with the headers the request rules look at; a file may lack these.
LANDED_BATCHES = T.StructType(
    [
        *EXPORT_BATCHES.fields,
        T.StructField("content_type", T.StringType()),
        T.StructField("body_bytes", T.LongType()),
    ]
)
