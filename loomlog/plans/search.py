"""The searches people run. Each one is scoped to a tenant."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label_col
from ..functions.patterns import is_valid_trace_id
from ..functions.times import DEFAULT_RANGE_NS, MAX_RANGE_NS, clamp_nanos, resolve_range, to_nanos
from ..operators.aggregates import to_streams
from ..operators.filters import LineFilter, Matcher, in_range, predicate, scope
from ..operators.ordering import (
    DEFAULT_LIMIT,
    MAX_LIMIT,
    latest_logs,
)
from ..schema import RESULT_COLUMNS

When = int | float | str | None


def _range(
    start: When, end: When, now_ns: int | None, widest: int | None = MAX_RANGE_NS
) -> tuple[int, int]:
    now_ns = time.time_ns() if now_ns is None else now_ns
    return resolve_range(to_nanos(start), to_nanos(end), now_ns, widest)


def matching(
    logs: DataFrame,
    tenant: str,
    matchers: Iterable[Matcher],
    filters: Iterable[LineFilter],
    start: int,
    end: int,
) -> DataFrame:
    rows = in_range(scope(logs, tenant), start, end)
    return rows.filter(predicate(logs.sparkSession, matchers, filters))


def log_query(
    logs: DataFrame,
    tenant: str,
    matchers: Iterable[Matcher],
    filters: Iterable[LineFilter] = (),
    start: When = None,
    end: When = None,
    limit: int = DEFAULT_LIMIT,
    direction: str | None = "backward",
    now_ns: int | None = None,
    max_limit: int | None = MAX_LIMIT,
    widest: int | None = MAX_RANGE_NS,
) -> DataFrame:
    """Matching rows of the last hour, or of the range given, newest first.

    A limit above `max_limit` or a range above `widest` is refused; None lifts either.
    """
    begin, until = _range(start, end, now_ns, widest)
    rows = matching(logs, tenant, matchers, filters, begin, until)
    return latest_logs(rows.select(*RESULT_COLUMNS), limit, direction, max_limit)


def log_query_range(
    logs: DataFrame,
    tenant: str,
    matchers: Iterable[Matcher],
    filters: Iterable[LineFilter] = (),
    start: When = None,
    end: When = None,
    limit: int = DEFAULT_LIMIT,
    direction: str | None = "backward",
    now_ns: int | None = None,
    max_limit: int | None = MAX_LIMIT,
    widest: int | None = MAX_RANGE_NS,
) -> DataFrame:
    """The same search as streams: one row per (service, severity)."""
    begin, until = _range(start, end, now_ns, widest)
    return to_streams(
        matching(logs, tenant, matchers, filters, begin, until), limit, direction, max_limit
    )


def log_query_instant(
    logs: DataFrame,
    tenant: str,
    matchers: Iterable[Matcher],
    filters: Iterable[LineFilter] = (),
    at: When = None,
    limit: int = DEFAULT_LIMIT,
    direction: str | None = "backward",
    now_ns: int | None = None,
    max_limit: int | None = MAX_LIMIT,
) -> DataFrame:
    """Streams of the hour that ends at `at`."""
    until = to_nanos(at)
    if until is None:
        until = time.time_ns() if now_ns is None else now_ns
    begin = clamp_nanos(until - DEFAULT_RANGE_NS)
    return to_streams(
        matching(logs, tenant, matchers, filters, begin, until), limit, direction, max_limit
    )


def trace_lookup(
    logs: DataFrame,
    tenant: str,
    trace_id: str,
    start: When = None,
    end: When = None,
    limit: int | None = None,
) -> DataFrame:
    """All rows of one trace, or the first `limit` of them, oldest first."""
    if not is_valid_trace_id(trace_id):
        raise ValueError("trace_id must be 32 lower-case hex characters")
    if (start is None) != (end is None):
        raise ValueError("start and end must be given together")
    rows = scope(logs, tenant).filter(F.col("trace_id") == trace_id)
    if start is not None:
        rows = in_range(rows, to_nanos(start), to_nanos(end))
    return latest_logs(rows.select(*RESULT_COLUMNS), limit, "forward", None)


def label_values(
    logs: DataFrame,
    name: str,
    tenant: str,
    start: When = None,
    end: When = None,
    now_ns: int | None = None,
    limit: int | None = None,
    in_maps: bool = False,
) -> DataFrame:
    """Distinct services or severities in order, all or the first `limit`.

    Other labels list no values unless `in_maps` asks for those kept in the maps,
    with which a search compares them.
    """
    begin, until = _range(start, end, now_ns)
    rows = in_range(scope(logs, tenant), begin, until)
    if name not in ("service", "severity") and not in_maps:
        return rows.select(F.lit("").alias("value")).limit(0)
    values = rows.select(label_col(name).alias("value")).distinct()
    if name not in ("service", "severity"):
        values = values.filter(F.col("value") != "")
    ordered = values.orderBy("value")
    return ordered if limit is None else ordered.limit(limit)


def label_names(
    logs: DataFrame,
    tenant: str,
    start: When = None,
    end: When = None,
    now_ns: int | None = None,
    fixed_only: bool = False,
) -> DataFrame:
    """Labels of a tenant and range, where they are kept, and how many rows have them.

    With `fixed_only` just the labels every row has; otherwise both maps are read.
    Counts combine before the shuffle.
    """
    begin, until = _range(start, end, now_ns)
    rows = in_range(scope(logs, tenant), begin, until)

    def entries(names: Column, source: str) -> Column:
        return F.transform(
            names, lambda n: F.struct(n.alias("label"), F.lit(source).alias("source"))
        )

    found = entries(F.array(F.lit("service"), F.lit("severity")), "column")
    if not fixed_only:
        found = F.concat(
            found,
            entries(F.map_keys("attrs"), "attrs"),
            entries(F.map_keys("resource"), "resource"),
        )
    return (
        rows.select(F.inline(found))
        .groupBy("label", "source")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def rows_as_json(rows: DataFrame) -> DataFrame:
    """Each result row as one JSON object, fields and map keys in name order."""
    fields = sorted(RESULT_COLUMNS)

    def field(name: str) -> Column:
        if name in ("attrs", "resource"):
            entries = F.sort_array(F.map_entries(name))
            return F.map_from_entries(entries).alias(name)
        return F.col(name)

    return rows.select(F.to_json(F.struct(*[field(name) for name in fields])).alias("json"))
