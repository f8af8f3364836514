"""Log-shaped views over the given tables, and the same views as DuckDB SQL.

Each view reads its table whole. Spark definitions and SQL stand side by side
so that a difference is easy to see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.session import configure

NOW = 1_706_659_200_000_000_000  # 2024-01-31T00:00:00Z
DAY = 86_400_000_000_000
MONTH_START = NOW - 30 * DAY

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

_NS = "unix_micros(cast(ts as timestamp)) * 1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet")
    return reader.parquet(sf_dir)


# --- logs -------------------------------------------------------------------


def logs_of(source: DataFrame) -> DataFrame:
    return source.withColumn("k", F.get_json_object("props", "$.k")).select(
        F.expr("concat('tenant-', user_id % 3)").alias("tenant_id"),
        F.expr(_NS).alias("ts"),
        F.expr(
            "case event_type when 'error' then 'ERROR' when 'purchase' then 'INFO'"
            " when 'signup' then 'WARN' when 'view' then 'DEBUG' else 'TRACE' end"
        ).alias("severity"),
        F.expr("concat('svc-', event_type)").alias("service"),
        F.expr(
            "case when event_id % 10 = 9 then '' else md5(cast(event_id div 4 as string)) end"
        ).alias("trace_id"),
        F.expr("substring(md5(concat('s', event_id)), 1, 16)").alias("span_id"),
        F.expr(
            "concat(event_type, ' user ', user_id, ' amount ', cast(floor(value) as bigint))"
        ).alias("body"),
        F.expr(
            "case event_id % 4 when 0 then map('env', '', 'k', k)"
            " when 1 then map('env', 'prod', 'k', k) else map('k', k) end"
        ).alias("attrs"),
        F.expr(
            "case event_id % 3 when 0 then map('env', 'stage') else map('region', 'r') end"
        ).alias("resource"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of(events(spark, sf_dir))


LOGS_SQL = """
logs AS (
  SELECT event_id,
    'tenant-' || (user_id % 3) AS tenant_id,
    epoch_us(ts) * 1000 AS ts,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'INFO'
      WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'TRACE' END AS severity,
    'svc-' || event_type AS service,
    CASE WHEN event_id % 10 = 9 THEN '' ELSE md5(CAST(event_id // 4 AS VARCHAR)) END AS trace_id,
    substr(md5('s' || event_id), 1, 16) AS span_id,
    event_type || ' user ' || user_id || ' amount ' || CAST(floor(value) AS BIGINT) AS body,
    json_extract_string(props, '$.k') AS attr_k,
    CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'prod' END AS attr_env,
    CASE WHEN event_id % 3 = 0 THEN 'stage' END AS res_env,
    CASE WHEN event_id % 3 <> 0 THEN 'r' END AS res_region,
    coalesce(attr_env, res_env, '') AS env,
    coalesce(res_region, '') AS region
  FROM events
)"""

FLAT = "ts, severity, service, trace_id, span_id, body, attr_k AS k, env, region"


def flat(rows: DataFrame) -> DataFrame:
    """Result rows without map columns, whose order a value hash would see."""
    def label(name: str):
        return F.coalesce(F.col("attrs")[name], F.col("resource")[name], F.lit(""))

    kept = [name for name in rows.columns if name not in ("attrs", "resource", "day", "load_id")]
    return rows.select(*kept, *[label(name).alias(name) for name in ("k", "env", "region")])


# --- long, multi-line, multilingual bodies ------------------------------------


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("id"),
        F.lit(0).cast("bigint").alias("part"), F.col("text").alias("body"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("conversation").alias("origin"), F.col("conv_id").alias("id"),
        F.col("turn").alias("part"), F.col("text").alias("body"),
    )
    return documents.unionByName(turns)


BODIES_SQL = """
bodies AS (
  SELECT 'document' AS origin, doc_id AS id, CAST(0 AS BIGINT) AS part, text AS body FROM documents
  UNION ALL
  SELECT 'conversation', conv_id, turn, text FROM conversations
)"""


# --- API keys -----------------------------------------------------------------


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key per customer; every seventh is revoked."""
    return table(spark, sf_dir, "customer").select(
        F.expr("md5(concat('id', c_custkey))").alias("id"),
        F.expr("sha2(concat('key-', c_custkey), 256)").alias("key_hash"),
        F.expr("concat('tenant-', c_custkey % 3)").alias("tenant_id"),
        F.expr("timestamp_seconds(1704067200 + c_custkey)").alias("created_at"),
        F.expr(
            "case when c_custkey % 7 = 3 then timestamp_seconds(1706000000 + c_custkey) end"
        ).alias("revoked_at"),
    )


KEYS_SQL = """
api_keys AS (
  SELECT c_custkey, md5('id' || c_custkey) AS id, sha256('key-' || c_custkey) AS key_hash,
    'tenant-' || (c_custkey % 3) AS tenant_id,
    1704067200 + c_custkey AS created_s,
    CASE WHEN c_custkey % 7 = 3 THEN 1706000000 + c_custkey END AS revoked_s
  FROM customer
)"""


def flat_keys(keys: DataFrame) -> DataFrame:
    return keys.select(
        "id", "key_hash", "tenant_id",
        F.unix_seconds("created_at").alias("created_s"),
        F.unix_seconds("revoked_at").alias("revoked_s"),
    )


# --- export records and batches -------------------------------------------------

_RECORD_COLUMNS = {
    "rid": "event_id div 50",
    "time_unix_nano": f"case event_id % 10 when 0 then 0L when 1 then {_NS} - {40 * DAY}L"
    f" when 2 then {_NS} + {60 * DAY}L else {_NS} end",
    "observed_time_unix_nano": f"case event_id % 4 when 0 then 0L"
    f" when 1 then {_NS} - {90 * DAY}L else {_NS} end",
    "severity_number": "cast(event_id % 27 as int)",
    "severity_text": "case when event_id % 2 = 0 then event_type else '' end",
    "trace_id": "case event_id % 13 when 0 then unhex(repeat('00', 16))"
    " when 1 then unhex(substring(md5(concat('', event_id)), 1, 30))"
    " else unhex(md5(concat('', event_id))) end",
    "span_id": "unhex(substring(md5(concat('s', event_id)), 1, 16))",
}

_NO_VALUE = "cast(null as struct<string_value:string,bool_value:boolean,int_value:bigint," \
    "double_value:double,bytes_value:binary,json_value:string>)"


def _value(**fields: str) -> str:
    """SQL of an attribute value with the given field set."""
    types = {
        "string_value": "string", "bool_value": "boolean", "int_value": "bigint",
        "double_value": "double", "bytes_value": "binary", "json_value": "string",
    }
    parts = [
        f"'{name}', cast({fields.get(name, 'null')} as {kind})" for name, kind in types.items()
    ]
    return f"named_struct({', '.join(parts)})"


def _pair(key: str, value: str) -> str:
    return f"named_struct('key', '{key}', 'value', {value})"


_BODY = (
    "case event_id % 5"
    f" when 0 then {_value(string_value='concat(event_type, chr(10), user_id)')}"
    f" when 1 then {_value(int_value='-user_id')}"
    f" when 2 then {_value(bool_value='user_id % 2 = 0')}"
    f" when 3 then {_value(double_value='value')}"
    f" else {_NO_VALUE} end"
)

# Every third record has only text attributes, the common case.
_TEXT_ATTRIBUTES = [
    _pair("k", _value(string_value="get_json_object(props, '$.k')")),
    _pair("dup", _value(string_value="'first'")),
    _pair("dup", _value(string_value="'last'")),
    _pair("a.first", _value(string_value="event_type")),
]
_MIXED_ATTRIBUTES = [
    *_TEXT_ATTRIBUTES,
    _pair("value", _value(double_value="value")),
    _pair("flag", _value(bool_value="event_id % 2 = 0")),
    _pair("n", _value(int_value="event_id")),
    _pair("raw", _value(bytes_value="unhex('DEAD')")),
    _pair("none", _NO_VALUE),
    _pair("list", _value(
        json_value="concat('{\"z\": [1, \"x\", 2.0], \"b\": {\"n\": ', user_id, '}, \"b\": null}')"
    )),
]
_ATTRIBUTES = (
    f"case when event_id % 3 = 0 then array({', '.join(_TEXT_ATTRIBUTES)})"
    f" else array({', '.join(_MIXED_ATTRIBUTES)}) end"
)


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        **_RECORD_COLUMNS, "body": _BODY, "attributes": _ATTRIBUTES,
    }
    return events(spark, sf_dir).select(
        "event_id", "user_id", "event_type",
        *[F.expr(sql).alias(name) for name, sql in columns.items()],
    )


RECORDS_SQL = f"""
records AS (
  SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k') AS k,
    event_id // 50 AS rid,
    epoch_us(ts) * 1000 AS t,
    CASE event_id % 10 WHEN 0 THEN 0 WHEN 1 THEN t - {40 * DAY} WHEN 2 THEN t + {60 * DAY}
      ELSE t END AS own,
    CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN t - {90 * DAY} ELSE t END AS observed,
    CAST(event_id % 27 AS INTEGER) AS severity_number,
    CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS severity_text,
    substr(md5('s' || event_id), 1, 16) AS span_id,
    CASE WHEN event_id % 13 <= 1 THEN '' ELSE md5(CAST(event_id AS VARCHAR)) END AS trace_id,
    own <> 0 AND own BETWEEN {NOW - 30 * DAY} AND {NOW + DAY // 24} AS own_ok,
    observed <> 0 AND observed BETWEEN {NOW - 30 * DAY} AND {NOW + DAY // 24} AS observed_ok,
    CASE WHEN own_ok THEN own WHEN observed_ok THEN observed ELSE {NOW} END AS ts,
    own <> 0 AND NOT own_ok AS clamped,
    CASE WHEN severity_number BETWEEN 1 AND 4 THEN 'TRACE'
      WHEN severity_number BETWEEN 5 AND 8 THEN 'DEBUG'
      WHEN severity_number BETWEEN 9 AND 12 THEN 'INFO'
      WHEN severity_number BETWEEN 13 AND 16 THEN 'WARN'
      WHEN severity_number BETWEEN 17 AND 20 THEN 'ERROR'
      WHEN severity_number BETWEEN 21 AND 24 THEN 'FATAL'
      WHEN severity_text <> '' THEN upper(severity_text) ELSE 'UNSPECIFIED' END AS severity,
    regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS value_text,
    CASE event_id % 5 WHEN 0 THEN event_type || chr(10) || user_id
      WHEN 1 THEN CAST(-user_id AS VARCHAR)
      WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END
      WHEN 3 THEN value_text ELSE '' END AS body,
    CASE event_type WHEN 'view' THEN 'unknown' ELSE event_type END AS service,
    event_id % 3 <> 0 AS mixed
  FROM events
),
senders AS (
  SELECT DISTINCT event_id // 50 AS rid,
    CASE WHEN rid % 11 = 5 THEN 'nokey-' || rid ELSE 'key-' || rid END AS api_key
  FROM events
)"""

ATTRS_TEXT_SQL = """'a.first=' || event_type || ';dup=last'
    || CASE WHEN mixed THEN ';flag=' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
      ELSE '' END
    || ';k=' || k
    || CASE WHEN mixed THEN ';list={"b":null,"z":[1,"x",2.0]};n=' || event_id
      || ';none=;raw=dead;value=' || value_text ELSE '' END"""


def map_text(column: str):
    """A map as text `key=value;...`, in the map's own order."""
    pairs = F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(pairs, ";")


def export_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of up to 50 records, one resource per event type, in two scopes.

    The resource of `view` has no service name.
    """
    record = F.struct(
        "time_unix_nano", "observed_time_unix_nano", "severity_number", "severity_text",
        "trace_id", "span_id", "body", "attributes",
    )
    scopes = (
        raw_records(spark, sf_dir)
        .groupBy("rid", "event_type", F.expr("event_id % 2").alias("scope"))
        .agg(F.collect_list(record).alias("log_records"))
    )
    pair = _pair("service.name", _value(string_value="event_type"))
    extra = _pair("host", _value(int_value="rid"))
    resource = F.expr(
        f"named_struct('attributes', case when event_type = 'view' then array({extra})"
        f" else array({pair}, {extra}) end)"
    ).alias("resource")
    resources = (
        scopes.groupBy("rid", "event_type")
        .agg(F.collect_list(F.struct("log_records")).alias("scope_logs"))
        .select("rid", F.struct(resource, "scope_logs").alias("resource_log"))
    )
    key = "case when rid % 11 = 5 then concat('nokey-', rid) else concat('key-', rid) end"
    return (
        resources.groupBy("rid")
        .agg(F.collect_list("resource_log").alias("resource_logs"))
        .select(
            F.col("rid").cast("string").alias("request_id"),
            F.expr(f"case when rid % 3 <> 0 then {key} end").alias("x_api_key"),
            F.expr(f"case when rid % 3 = 0 then concat('Bearer ', {key}) end")
            .alias("authorization"),
            "resource_logs",
        )
    )


# --- the same requests as standard export JSON -------------------------------------


def typed(kind: str, value: str) -> str:
    """SQL of the JSON text of a value of one kind."""
    return f"to_json(named_struct('{kind}', {value}))"


def typed_pair(key: str, value: str | None) -> str:
    name = f"'{{\"key\":\"{key}\"'"
    return f"concat({name}, ',\"value\":', {value}, '}}')" if value else f"concat({name}, '}}')"


def typed_list(*values: str) -> str:
    return f"concat('{{\"arrayValue\":{{\"values\":[', concat_ws(',', {', '.join(values)}), ']}}}}')"


def typed_map(*pairs: str) -> str:
    return f"concat('{{\"kvlistValue\":{{\"values\":[', concat_ws(',', {', '.join(pairs)}), ']}}}}')"


_TYPED_BODY = (
    "case event_id % 5"
    f" when 0 then {typed('stringValue', 'concat(event_type, chr(10), user_id)')}"
    f" when 1 then {typed('intValue', 'cast(-user_id as string)')}"
    f" when 2 then {typed('boolValue', 'user_id % 2 = 0')}"
    f" when 3 then {typed('doubleValue', 'value')} else 'null' end"
)
_TYPED_TEXTS = [
    typed_pair("k", typed("stringValue", "get_json_object(props, '$.k')")),
    typed_pair("dup", typed("stringValue", "'first'")),
    typed_pair("dup", typed("stringValue", "'last'")),
    typed_pair("a.first", typed("stringValue", "event_type")),
]
#: {"z": [1, "x", 2.0], "b": {"n": user}, "b": none}: the last `b` counts.
TYPED_TREE = typed_map(
    typed_pair("z", typed_list(typed("intValue", "'1'"), typed("stringValue", "'x'"), typed("doubleValue", "2.0D"))),
    typed_pair("b", typed_map(typed_pair("n", typed("intValue", "cast(user_id as string)")))),
    typed_pair("b", None),
)
_TYPED_MIXED = [
    *_TYPED_TEXTS,
    typed_pair("value", typed("doubleValue", "value")),
    typed_pair("flag", typed("boolValue", "event_id % 2 = 0")),
    typed_pair("n", typed("intValue", "event_id")),
    typed_pair("raw", typed("bytesValue", "base64(unhex('DEAD'))")),
    typed_pair("none", "'{}'"),
    typed_pair("list", TYPED_TREE),
]


def _joined_texts(*parts: str) -> str:
    return f"concat('[', concat_ws(',', {', '.join(parts)}), ']')"


def _texts_of(column: str):
    return F.concat(F.lit("["), F.array_join(F.collect_list(column), ","), F.lit("]"))


def standard_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of `export_batches` as lines (`value`) of standard export JSON."""
    plain = {
        "timeUnixNano": "cast(time_unix_nano as string)",
        "observedTimeUnixNano": "cast(observed_time_unix_nano as string)",
        "severityNumber": "severity_number",
        "severityText": "severity_text",
        "traceId": "lower(hex(trace_id))",
        "spanId": "hex(span_id)",
    }
    rows = events(spark, sf_dir).selectExpr(
        "*", *[f"{sql} as {name}" for name, sql in _RECORD_COLUMNS.items()]
    )
    fields = ", ".join(f"'{name}', {sql}" for name, sql in plain.items())
    head = f"to_json(named_struct({fields}))"
    attributes = f"case when event_id % 3 = 0 then {_joined_texts(*_TYPED_TEXTS)} else {_joined_texts(*_TYPED_MIXED)} end"
    record = f"""concat(left({head}, length({head}) - 1), ',"body":', {_TYPED_BODY}, ',"attributes":', {attributes}, '}}')"""
    scopes = (
        rows.select("rid", "event_type", F.expr("event_id % 2").alias("scope"), F.expr(record).alias("record"))
        .groupBy("rid", "event_type", "scope")
        .agg(F.concat(F.lit('{"scope":{"name":"s"},"logRecords":'), _texts_of("record"), F.lit("}")).alias("scope_text"))
    )
    host = typed_pair("host", typed("intValue", "cast(rid as string)"))
    name = typed_pair("service.name", typed("stringValue", "event_type"))
    own = f"case when event_type = 'view' then {_joined_texts(host)} else {_joined_texts(name, host)} end"
    resources = (
        scopes.groupBy("rid", "event_type")
        .agg(_texts_of("scope_text").alias("scope_texts"))
        .selectExpr("rid", f"""concat('{{"resource":{{"attributes":', {own}, '}},"scopeLogs":', scope_texts, '}}') as resource_text""")
    )
    key = "case when rid % 11 = 5 then concat('nokey-', rid) else concat('key-', rid) end"
    headers = f"""to_json(named_struct('request_id', cast(rid as string),
        'x_api_key', case when rid % 3 <> 0 then {key} end,
        'authorization', case when rid % 3 = 0 then concat('Bearer ', {key}) end))"""
    return (
        resources.groupBy("rid")
        .agg(_texts_of("resource_text").alias("resource_texts"))
        .selectExpr(f"""concat(left({headers}, length({headers}) - 1), ',"resourceLogs":', resource_texts, '}}') as value""")
    )


# --- requests and pipeline events -------------------------------------------------

MAX_TEST_ROWS = 40

_REQUEST_COLUMNS = {
    "request_id": "event_id",
    "arrived_ns": _NS,
    "at": "cast(ts as timestamp)",
    "content_type": "case event_id % 11 when 0 then null when 1 then 'application/json'"
    " when 2 then 'application/x-protobuf; charset=utf-8' else 'application/x-protobuf' end",
    "x_api_key": "case event_id % 9 when 0 then null when 1 then null when 2 then null"
    " when 3 then concat('nokey-', user_id) else concat('key-', user_id) end",
    "authorization": "case event_id % 9 when 1 then concat('Bearer key-', user_id)"
    " when 2 then concat('bearer key-', user_id) when 4 then 'Bearer nokey' end",
    "body_bytes": "case event_id % 17 when 0 then 16777217L when 1 then 16777216L"
    " else 1000 + event_id end",
    "readable": "event_id % 19 <> 0",
    "record_count": "user_id % 50",
}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        *[F.expr(sql).alias(name) for name, sql in _REQUEST_COLUMNS.items()]
    )


REQUESTS_SQL = f"""
requests AS (
  SELECT event_id AS request_id, epoch_us(ts) * 1000 AS arrived_ns, user_id,
    CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'application/json'
      WHEN 2 THEN 'application/x-protobuf; charset=utf-8'
      ELSE 'application/x-protobuf' END AS content_type,
    CASE event_id % 9 WHEN 0 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'nokey-' || user_id
      ELSE 'key-' || user_id END AS api_key,
    CASE event_id % 17 WHEN 0 THEN 16777217 WHEN 1 THEN 16777216
      ELSE 1000 + event_id END AS body_bytes,
    event_id % 19 <> 0 AS readable,
    user_id % 50 AS record_count
  FROM events
),
{KEYS_SQL.strip()},
routed AS (
  SELECT r.*, k.tenant_id,
    CASE WHEN r.content_type IS NOT NULL
        AND NOT starts_with(r.content_type, 'application/x-protobuf')
        THEN 'unsupported_content_type'
      WHEN r.api_key IS NULL THEN 'missing_key'
      WHEN k.tenant_id IS NULL THEN 'invalid_key'
      WHEN r.body_bytes > 16777216 THEN 'body_too_large'
      WHEN NOT r.readable THEN 'unreadable_body'
      WHEN r.record_count > {MAX_TEST_ROWS} THEN 'too_many_records'
      ELSE 'accepted' END AS outcome
  FROM requests r LEFT JOIN api_keys k
    ON sha256(r.api_key) = k.key_hash AND k.revoked_s IS NULL
)"""

_PIPELINE_COLUMNS = {
    "at": "cast(ts as timestamp)",
    "arrived_ns": _NS,
    "tenant_id": "concat('tenant-', user_id % 3)",
    "source": "case when event_id % 6 = 0 then 'query' else 'ingest' end",
    "status": "case when event_id % 6 = 0 then case when event_id % 8 = 0 then 502 else 200 end"
    " when event_id % 5 in (1, 2) then 429 else 200 end",
    "rows": "user_id % 50",
    "drop_reason": "case when event_id % 6 = 0 then null when event_id % 5 = 1 then 'buffer_full'"
    " when event_id % 5 = 2 then 'channel_full' when event_id % 35 = 3 then 'flush_error'"
    " when event_id % 105 = 4 then 'flush_panic' end",
    "clamped": "case when event_id % 10 = 1 then user_id % 3 else 0L end",
    "flush_us": "cast(floor(value * 1000) as bigint)",
}


def pipeline_events_of(source: DataFrame) -> DataFrame:
    return source.select(
        "event_type", *[F.expr(sql).alias(name) for name, sql in _PIPELINE_COLUMNS.items()]
    )


def pipeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pipeline reports about itself: one row per request."""
    return pipeline_events_of(events(spark, sf_dir))


PIPELINE_SQL = """
pipeline AS (
  SELECT event_type, epoch_us(ts) AS at_us, epoch_us(ts) * 1000 AS arrived_ns,
    'tenant-' || (user_id % 3) AS tenant_id,
    CASE WHEN event_id % 6 = 0 THEN 'query' ELSE 'ingest' END AS source,
    CASE WHEN event_id % 6 = 0 THEN CASE WHEN event_id % 8 = 0 THEN 502 ELSE 200 END
      WHEN event_id % 5 IN (1, 2) THEN 429 ELSE 200 END AS status,
    user_id % 50 AS rows,
    CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'buffer_full'
      WHEN event_id % 5 = 2 THEN 'channel_full' WHEN event_id % 35 = 3 THEN 'flush_error'
      WHEN event_id % 105 = 4 THEN 'flush_panic' END AS drop_reason,
    CASE WHEN event_id % 10 = 1 THEN user_id % 3 ELSE 0 END AS clamped,
    CAST(floor(value * 1000) AS BIGINT) AS flush_us
  FROM events
)"""
