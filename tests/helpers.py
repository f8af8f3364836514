"""Rows, times and plan texts that several test files use."""

from __future__ import annotations

NOW = 1_706_659_200_000_000_000
SECOND = 1_000_000_000
DAY = 86_400 * SECOND


def log_row(tenant="a", ts=NOW, severity="INFO", service="ledger", trace="", span="", body="",
            attrs=None, resource=None):
    return (tenant, ts, severity, service, trace, span, body, attrs or {}, resource or {})


def plan_of(frame, mode="formatted") -> str:
    """The physical plan as text."""
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )
