"""Searches, filters and label listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.functions.labels import label_col
from loomlog.functions.patterns import valid_trace_id_col
from loomlog.functions.times import resolve_range_cols
from loomlog.operators.checks import isolation_violations
from loomlog.operators.filters import in_range, line_col, matcher_col
from loomlog.operators.ordering import latest_logs
from loomlog.plans import search
from loomlog.schema import RESULT_COLUMNS

from .fixtures import (
    BODIES_SQL,
    DAY,
    FLAT,
    LOGS_SQL,
    MONTH_START,
    NOW,
    bodies,
    events,
    flat,
    logs,
)
from .registry import register

TENANT = "tenant-1"
HALF = MONTH_START + 15 * DAY
NEWEST = "ORDER BY ts DESC, span_id, service, severity, body"
OLDEST = "ORDER BY ts, span_id, service, severity, body"
IN_MONTH = f"tenant_id = '{TENANT}' AND ts >= {NOW - 31 * DAY} AND ts < {NOW}"


@register(
    "log_query",
    f"""SELECT {FLAT} FROM logs WHERE {IN_MONTH}
      AND regexp_full_match(service, 'svc-(error|view)', 's')
      AND regexp_matches(body, 'amount 1[0-9]+$', 's')
      {NEWEST} LIMIT 100""",
    (LOGS_SQL,),
)
def log_query(spark, sf_dir):
    return flat(
        search.log_query(
            logs(spark, sf_dir),
            TENANT,
            [("service", "=~", "svc-(error|view)")],
            [("|~", "amount 1[0-9]+$")],
            start=MONTH_START - DAY,
            now_ns=NOW,
        )
    )


@register(
    "log_query_panel",
    f"SELECT {FLAT} FROM logs WHERE {IN_MONTH} AND service <> '' {NEWEST} LIMIT 5000",
    (LOGS_SQL,),
)
def log_query_panel(spark, sf_dir):
    """The dashboard's log panel: every service, the largest allowed result."""
    return flat(
        search.log_query(
            logs(spark, sf_dir), TENANT, [("service", "=~", ".+")],
            start=MONTH_START, limit=5000, now_ns=NOW,
        )
    )


@register(
    "latest_logs",
    f"SELECT tenant_id, {FLAT} FROM logs {OLDEST}, tenant_id LIMIT 500",
    (LOGS_SQL,),
)
def oldest_logs(spark, sf_dir):
    return flat(latest_logs(logs(spark, sf_dir), 500, "forward"))


STREAMS_SQL = """SELECT service, severity,
      to_json(list([CAST(ts AS VARCHAR), body] ORDER BY {order}, span_id, body)) AS "values"
    FROM picked GROUP BY service, severity"""


def _streams(rows):
    return rows.select("service", "severity", F.to_json("values").alias("values"))


@register(
    "log_query_range",
    f"""SELECT * FROM (WITH picked AS (SELECT * FROM logs WHERE {IN_MONTH}
        AND env <> 'prod' AND NOT contains(body, 'purchase') {NEWEST} LIMIT 1000)
      {STREAMS_SQL.format(order="ts DESC")})""",
    (LOGS_SQL,),
)
def log_query_range(spark, sf_dir):
    return _streams(
        search.log_query_range(
            logs(spark, sf_dir), TENANT, [("env", "!=", "prod")], [("!=", "purchase")],
            start=MONTH_START, limit=1000, now_ns=NOW,
        )
    )


@register(
    "log_query_instant",
    f"""SELECT * FROM (WITH picked AS (SELECT * FROM logs
        WHERE tenant_id = '{TENANT}' AND ts >= {HALF - DAY // 24} AND ts < {HALF}
        AND severity <> '' {NEWEST} LIMIT 100)
      {STREAMS_SQL.format(order="ts DESC")})""",
    (LOGS_SQL,),
)
def log_query_instant(spark, sf_dir):
    return _streams(
        search.log_query_instant(
            logs(spark, sf_dir), TENANT, [("severity", "!=", "")], at=HALF // 10**9
        )
    )


@register(
    "log_streams",
    f"""SELECT * FROM (WITH picked AS (SELECT * FROM logs
        WHERE tenant_id = '{TENANT}' {OLDEST} LIMIT 5000)
      {STREAMS_SQL.format(order="ts")})""",
    (LOGS_SQL,),
)
def log_streams(spark, sf_dir):
    from loomlog.operators.aggregates import to_streams
    from loomlog.operators.filters import scope

    return _streams(to_streams(scope(logs(spark, sf_dir), TENANT), 5000, "forward"))


TRACE_OF = "md5('25')"


@register(
    "trace_lookup",
    f"""SELECT {FLAT} FROM logs WHERE tenant_id = '{TENANT}' AND trace_id = {TRACE_OF}
      {OLDEST} LIMIT 5000""",
    (LOGS_SQL,),
)
def trace_lookup(spark, sf_dir):
    import hashlib

    trace = hashlib.md5(b"25").hexdigest()
    return flat(search.trace_lookup(logs(spark, sf_dir), TENANT, trace))


@register(
    "label_values",
    f"SELECT DISTINCT severity AS value FROM logs WHERE {IN_MONTH} ORDER BY 1 LIMIT 1000",
    (LOGS_SQL,),
)
def label_values(spark, sf_dir):
    return search.label_values(
        logs(spark, sf_dir), "severity", TENANT, start=MONTH_START, now_ns=NOW
    )


@register(
    "label_names",
    f"""SELECT label, source, count(*) AS rows FROM (
        SELECT unnest(['service', 'severity', 'k']) AS label,
          unnest(['column', 'column', 'attrs']) AS source FROM logs WHERE {IN_MONTH}
        UNION ALL SELECT 'env', 'attrs' FROM logs WHERE {IN_MONTH} AND attr_env IS NOT NULL
        UNION ALL SELECT 'env', 'resource' FROM logs WHERE {IN_MONTH} AND res_env IS NOT NULL
        UNION ALL SELECT 'region', 'resource' FROM logs
          WHERE {IN_MONTH} AND res_region IS NOT NULL
      ) GROUP BY ALL""",
    (LOGS_SQL,),
)
def label_names(spark, sf_dir):
    return search.label_names(logs(spark, sf_dir), TENANT, start=MONTH_START, now_ns=NOW)


@register(
    "tenant_isolation_check",
    f"""SELECT (SELECT count(*) FROM (SELECT 1 FROM logs
          WHERE {IN_MONTH} AND region = 'r' LIMIT 5000)) AS returned,
        CAST(0 AS BIGINT) AS own_violations,
        (SELECT count(*) FROM (SELECT 1 FROM logs
          WHERE {IN_MONTH} AND region = 'r' LIMIT 5000)) AS foreign_violations""",
    (LOGS_SQL,),
)
def tenant_isolation_check(spark, sf_dir):
    """A search checked for its own tenant, and, to show a hit, for another one."""
    table = logs(spark, sf_dir)
    rows = search.log_query(
        table, TENANT, [("region", "=", "r")], start=MONTH_START, limit=5000, now_ns=NOW
    )
    own = isolation_violations(table, TENANT, rows)
    foreign = isolation_violations(table, "tenant-2", rows)

    def count(frame, name):
        return frame.agg(F.count(F.lit(1)).alias(name))

    return (
        count(rows, "returned")
        .crossJoin(count(own, "own_violations"))
        .crossJoin(count(foreign, "foreign_violations"))
    )


@register(
    "tenant_isolation_check_whole",
    f"""SELECT count(*) AS returned, CAST(0 AS BIGINT) AS own_violations,
        count(*) AS foreign_violations FROM logs WHERE {IN_MONTH} AND region = 'r'""",
    (LOGS_SQL,),
)
def tenant_isolation_check_whole(spark, sf_dir):
    """All rows of the search, whatever their number."""
    table = logs(spark, sf_dir)
    rows = search.log_query(
        table, TENANT, [("region", "=", "r")], start=MONTH_START, limit=None, now_ns=NOW, max_limit=None
    )
    own = isolation_violations(table, TENANT, rows)
    foreign = isolation_violations(table, "tenant-2", rows)
    named = {"returned": rows, "own_violations": own, "foreign_violations": foreign}
    first, *more = [frame.select(F.lit(name).alias("part")) for name, frame in named.items()]
    for frame in more:
        first = first.unionByName(frame)
    return first.agg(*[F.count_if(F.col("part") == name).alias(name) for name in named])


@register(
    "rows_as_json",
    """SELECT '{"attrs":{' || CASE WHEN attr_env IS NOT NULL
          THEN '"env":"' || attr_env || '",' ELSE '' END || '"k":"' || attr_k || '"}'
        || ',"body":"' || body || '","resource":{'
        || CASE WHEN res_env IS NOT NULL THEN '"env":"stage"' ELSE '"region":"r"' END
        || '},"service":"' || service || '","severity":"' || severity || '","span_id":"' || span_id
        || '","trace_id":"' || trace_id || '","ts":' || ts || '}' AS json FROM logs""",
    (LOGS_SQL,),
)
def rows_as_json(spark, sf_dir):
    return search.rows_as_json(logs(spark, sf_dir).select(*RESULT_COLUMNS))


# --- single filters over the whole table -------------------------------------------


@register(
    "time_range",
    f"SELECT tenant_id, {FLAT} FROM logs WHERE ts >= {HALF} AND ts < {HALF + 7 * DAY}",
    (LOGS_SQL,),
)
def time_range(spark, sf_dir):
    return flat(in_range(logs(spark, sf_dir), HALF, HALF + 7 * DAY))


@register(
    "resolve_range",
    f"""SELECT event_id, greatest(coalesce(s, e - 3600000000000), e - {31 * DAY}) AS start_ns,
        e AS end_ns FROM (
      SELECT event_id,
        CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) * 1000 - (event_id % 50) * {DAY} END AS s,
        CASE WHEN event_id % 4 <> 0 THEN epoch_us(ts) * 1000 ELSE {NOW} END AS e FROM events)""",
)
def resolve_range(spark, sf_dir):
    saved = events(spark, sf_dir).selectExpr(
        "event_id",
        f"case when event_id % 3 <> 0 then unix_micros(cast(ts as timestamp)) * 1000"
        f" - (event_id % 50) * {DAY} end as s",
        "case when event_id % 4 <> 0 then unix_micros(cast(ts as timestamp)) * 1000 end as e",
    )
    start, end = resolve_range_cols(F.col("s"), F.col("e"), NOW)
    return saved.select("event_id", start.alias("start_ns"), end.alias("end_ns"))


@register(
    "label_value",
    """SELECT span_id, env, region, attr_k AS k, '' AS missing, service, trace_id FROM logs""",
    (LOGS_SQL,),
)
def label_value(spark, sf_dir):
    names = ("span_id", "env", "region", "k", "missing", "service", "trace_id")
    return logs(spark, sf_dir).select(*[label_col(name).alias(name) for name in names])


def _label_query(name, matchers, condition):
    @register(name, f"SELECT tenant_id, {FLAT} FROM logs WHERE {condition}", (LOGS_SQL,))
    def query(spark, sf_dir):
        rows = logs(spark, sf_dir)
        for matcher in matchers:
            rows = rows.filter(matcher_col(spark, matcher))
        return flat(rows)


_label_query("label_eq", [("env", "=", "")], "env = ''")
_label_query("label_eq_column", [("service", "=", "svc-error")], "service = 'svc-error'")
_label_query(
    "label_neq", [("region", "!=", "r"), ("nowhere", "!=", "x")], "region <> 'r'"
)
_label_query(
    "label_match",
    [("k", "=~", "[1-3]?7|4."), ("severity", "=~", "(INF|ERR).*")],
    "regexp_full_match(attr_k, '[1-3]?7|4.', 's')"
    " AND regexp_full_match(severity, '(INF|ERR).*', 's')",
)
_label_query(
    "label_match_plain",
    [("service", "=~", "svc-.*"), ("severity", "=~", "INFO|WARN"), ("env", "=~", ".+")],
    "starts_with(service, 'svc-') AND severity IN ('INFO', 'WARN') AND env <> ''",
)
_label_query(
    "label_not_match",
    [("env", "!~", "pro.|x?"), ("service", "!~", "svc-(click|view)")],
    "NOT regexp_full_match(env, 'pro.|x?', 's')"
    " AND NOT regexp_full_match(service, 'svc-(click|view)', 's')",
)


def _line_query(name, line_filter, condition):
    @register(
        name,
        f"SELECT origin, id, part, CAST(length(body) AS INTEGER) AS chars FROM bodies"
        f" WHERE {condition}",
        (BODIES_SQL,),
    )
    def query(spark, sf_dir):
        return (
            bodies(spark, sf_dir)
            .filter(line_col(spark, line_filter))
            .select("origin", "id", "part", F.length("body").alias("chars"))
        )


_line_query("line_contains", ("|=", "tion le"), "contains(body, 'tion le')")
_line_query("line_not_contains", ("!=", "the "), "NOT contains(body, 'the ')")
_line_query(
    "line_match", ("|~", r"(?i)\ban[a-zé]+ed\b.+\.$"),
    r"regexp_matches(body, '(?i)\ban[a-zé]+ed\b.+\.$', 's')",
)
_line_query(
    "line_not_match", ("!~", r"[A-Z][a-z]+,\s(?:is|la|of)\b"),
    r"NOT regexp_matches(body, '[A-Z][a-z]+,\s(?:is|la|of)\b', 's')",
)


@register(
    "valid_trace_id",
    """SELECT event_id, regexp_full_match(candidate, '[0-9a-f]{32}') AS valid FROM (
      SELECT event_id, CASE event_id % 5 WHEN 0 THEN upper(md5(CAST(event_id AS VARCHAR)))
        WHEN 1 THEN substr(md5(CAST(event_id AS VARCHAR)), 2)
        WHEN 2 THEN md5(CAST(event_id AS VARCHAR)) || chr(10)
        WHEN 3 THEN '' ELSE md5(CAST(event_id AS VARCHAR)) END AS candidate FROM events)""",
)
def valid_trace_id(spark, sf_dir):
    candidate = F.expr(
        "case event_id % 5 when 0 then upper(md5(cast(event_id as string)))"
        " when 1 then substring(md5(cast(event_id as string)), 2)"
        " when 2 then concat(md5(cast(event_id as string)), chr(10))"
        " when 3 then '' else md5(cast(event_id as string)) end"
    )
    return events(spark, sf_dir).select("event_id", valid_trace_id_col(candidate).alias("valid"))
