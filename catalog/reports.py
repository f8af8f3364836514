"""Aggregates of logs and reports on the health of the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.operators import aggregates
from loomlog.plans.alerts import alert_rates, flush_p99

from .fixtures import DAY, LOGS_SQL, MONTH_START, NOW, PIPELINE_SQL, logs, pipeline_events
from .registry import register

HOUR = DAY // 24


@register(
    "severity_over_time",
    f"""SELECT ts - ts % {HOUR} AS time, severity, count(*) AS c FROM logs
      WHERE ts BETWEEN {MONTH_START} AND {NOW - DAY} GROUP BY ALL ORDER BY time, severity""",
    (LOGS_SQL,),
)
def severity_over_time(spark, sf_dir):
    return aggregates.severity_over_time(logs(spark, sf_dir), MONTH_START, NOW - DAY, HOUR)


@register(
    "top_services",
    """SELECT service, count(*) AS count FROM logs GROUP BY service
      ORDER BY count DESC, service LIMIT 10""",
    (LOGS_SQL,),
)
def top_services(spark, sf_dir):
    return aggregates.top_services(logs(spark, sf_dir))


@register(
    "count_by_tenant", "SELECT tenant_id, count(*) AS rows FROM logs GROUP BY ALL", (LOGS_SQL,)
)
def count_by_tenant(spark, sf_dir):
    return aggregates.count_by_tenant(logs(spark, sf_dir))


@register(
    "count_by_trace", "SELECT tenant_id, trace_id, count(*) AS rows FROM logs GROUP BY ALL",
    (LOGS_SQL,),
)
def count_by_trace(spark, sf_dir):
    return aggregates.count_by_trace(logs(spark, sf_dir))


@register(
    "requests_by_status", "SELECT status, count(*) AS requests FROM pipeline GROUP BY ALL",
    (PIPELINE_SQL,),
)
def requests_by_status(spark, sf_dir):
    return aggregates.requests_by_status(pipeline_events(spark, sf_dir))


@register(
    "accepted_rows",
    """SELECT CAST(sum(CASE WHEN status = 200 THEN rows ELSE 0 END) AS BIGINT) AS accepted,
      CAST(sum(CASE WHEN status = 200 AND drop_reason IS NULL THEN rows ELSE 0 END) AS BIGINT)
        AS flushed FROM pipeline WHERE source = 'ingest'""",
    (PIPELINE_SQL,),
)
def accepted_rows(spark, sf_dir):
    return aggregates.row_totals(pipeline_events(spark, sf_dir).filter("source = 'ingest'"))


@register(
    "dropped_rows",
    """SELECT drop_reason AS reason, CAST(sum(rows) AS BIGINT) AS rows FROM pipeline
      WHERE drop_reason IS NOT NULL GROUP BY ALL""",
    (PIPELINE_SQL,),
)
def dropped_rows(spark, sf_dir):
    return aggregates.dropped_rows(pipeline_events(spark, sf_dir))


RANKED_SQL = """SELECT {group} n, max(CASE WHEN rn = p50 THEN flush_us END) AS p50,
    max(CASE WHEN rn = p99 THEN flush_us END) AS p99, max(flush_us) AS max
  FROM (SELECT *, count(*) OVER w AS n,
      row_number() OVER (PARTITION BY {by} ORDER BY flush_us) - 1 AS rn,
      CAST(floor((n - 1) * 0.5::DOUBLE + 0.5) AS BIGINT) AS p50,
      CAST(floor((n - 1) * 0.99::DOUBLE + 0.5) AS BIGINT) AS p99
    FROM (SELECT *, at_us - at_us % 300000000 AS window_start_us FROM pipeline)
    WINDOW w AS (PARTITION BY {by}))
  GROUP BY {by}, n"""


@register(
    "latency_summary", RANKED_SQL.format(group="tenant_id, status,", by="tenant_id, status"),
    (PIPELINE_SQL,),
)
def latency_summary(spark, sf_dir):
    return aggregates.latency_summary(
        pipeline_events(spark, sf_dir), "flush_us", by=["tenant_id", "status"]
    )


@register(
    "latency_summary_all", RANKED_SQL.format(group="", by="1 = 1"), (PIPELINE_SQL,),
)
def latency_summary_all(spark, sf_dir):
    """One group that holds every row."""
    return aggregates.latency_summary(pipeline_events(spark, sf_dir), "flush_us")


@register(
    "throughput",
    """SELECT requests, elapsed_s, accepted / elapsed_s AS accepted_per_s,
      attempted / elapsed_s AS attempted_per_s, refused / requests::DOUBLE AS share_429
    FROM (SELECT count(*) AS requests,
      (max(arrived_ns) - min(arrived_ns))::DOUBLE / 1e9::DOUBLE AS elapsed_s,
      sum(CASE WHEN status = 200 THEN rows ELSE 0 END)::DOUBLE AS accepted,
      sum(rows)::DOUBLE AS attempted,
      sum(CASE WHEN status = 429 THEN 1 ELSE 0 END)::DOUBLE AS refused
      FROM pipeline WHERE source = 'ingest')""",
    (PIPELINE_SQL,),
)
def throughput(spark, sf_dir):
    return aggregates.throughput(pipeline_events(spark, sf_dir).filter("source = 'ingest'"))


BOUNDS = (1_000, 5_000, 25_000, 100_000, 250_000, 1_000_000)


@register(
    "flush_duration_histogram",
    f"""SELECT CAST(b AS VARCHAR) AS le,
        CAST(count(CASE WHEN flush_us <= b THEN 1 END) AS BIGINT) AS count
      FROM pipeline, (SELECT unnest({list(BOUNDS)}) AS b) GROUP BY b
    UNION ALL SELECT '+Inf', count(*) FROM pipeline""",
    (PIPELINE_SQL,),
)
def flush_duration_histogram(spark, sf_dir):
    return aggregates.duration_histogram(pipeline_events(spark, sf_dir), "flush_us", BOUNDS)


RATES_SQL = """SELECT s AS window_start_us, s + {width} AS window_end_us,
    CAST(sum(CASE WHEN drop_reason = 'flush_error' THEN rows ELSE 0 END) AS BIGINT)
      AS flush_error_rows,
    CAST(sum(CASE WHEN drop_reason = 'flush_panic' THEN rows ELSE 0 END) AS BIGINT)
      AS flush_panic_rows,
    CAST(sum(CASE WHEN drop_reason = 'buffer_full' THEN rows ELSE 0 END) AS BIGINT)
      AS buffer_full_rows,
    CAST(sum(clamped) AS BIGINT) AS clamped_rows,
    count(CASE WHEN source = 'query' AND status BETWEEN 500 AND 599 THEN 1 END) AS query_5xx,
    coalesce(count(CASE WHEN source = 'ingest' AND status = 429 THEN 1 END)::DOUBLE
      / nullif(count(CASE WHEN source = 'ingest' THEN 1 END), 0)::DOUBLE, 0.0::DOUBLE) AS share_429,
    (flush_error_rows > 0 OR flush_panic_rows > 0) AS data_loss,
    buffer_full_rows > 0 AS backpressure, query_5xx > 0 AS query_errors
  FROM (SELECT *, unnest({starts}) AS s FROM pipeline) GROUP BY s"""

FIVE_MINUTES = 300_000_000


@register(
    "alert_rates",
    RATES_SQL.format(width=FIVE_MINUTES, starts=f"[at_us - at_us % {FIVE_MINUTES}]"),
    (PIPELINE_SQL,),
)
def alerts(spark, sf_dir):
    return alert_rates(pipeline_events(spark, sf_dir))


@register(
    "alert_rates_sliding",
    RATES_SQL.format(
        width=FIVE_MINUTES,
        starts="[at_us - at_us % 60000000 - i * 60000000 for i in [0, 1, 2, 3, 4]]",
    ),
    (PIPELINE_SQL,),
)
def alerts_sliding(spark, sf_dir):
    return alert_rates(pipeline_events(spark, sf_dir), slide="1 minute")


@register(
    "alert_flush_p99",
    "SELECT window_start_us, n, p99, max FROM ("
    + RANKED_SQL.format(group="window_start_us,", by="window_start_us")
    + ")",
    (PIPELINE_SQL,),
)
def alert_flush_p99(spark, sf_dir):
    return flush_p99(pipeline_events(spark, sf_dir)).select(
        "window_start_us", "n", F.col("p99"), "max"
    )
