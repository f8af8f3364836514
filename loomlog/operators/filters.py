"""Row filters of a log search. Everything here is one `Column` or one `filter`."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.labels import label_col
from ..functions.mapping import NANOS_MAX, NANOS_MIN
from ..functions.times import day_of

Matcher = tuple[str, str, str]  # label, one of = != =~ !~, value
LineFilter = tuple[str, str]  # one of |= != |~ !~, value


def scope(logs: DataFrame, tenant: str) -> DataFrame:
    """Rows of one tenant. Every search starts here."""
    return logs.filter(F.col("tenant_id") == tenant)


def in_range(logs: DataFrame, start: int, end: int) -> DataFrame:
    """Rows with `start <= ts < end`.

    Spark does not derive the partition day from `ts`, so on a stored table
    the day bounds are added and whole days are skipped at planning time.
    """
    logs = logs.filter((F.col("ts") >= start) & (F.col("ts") < end))
    if "day" not in logs.columns:
        return logs
    first, last = (max(NANOS_MIN, min(NANOS_MAX, ns)) for ns in (start, end - 1))
    return logs.filter(F.col("day").between(F.lit(day_of(first)), F.lit(day_of(last))))


def matcher_col(spark: SparkSession, matcher: Matcher) -> Column:
    name, op, value = matcher
    label = label_col(name)
    if op == "=":
        return label == value
    if op == "!=":
        return label != value
    if op == "=~":
        return patterns.full_match(spark, label, value)
    if op == "!~":
        return ~patterns.full_match(spark, label, value)
    raise ValueError(f"unknown label operator {op!r}")


def line_col(spark: SparkSession, line_filter: LineFilter, body: str = "body") -> Column:
    op, value = line_filter
    if op == "|=":
        return F.col(body).contains(value)
    if op == "!=":
        return ~F.col(body).contains(value)
    if op == "|~":
        return patterns.search_match(spark, F.col(body), value)
    if op == "!~":
        return ~patterns.search_match(spark, F.col(body), value)
    raise ValueError(f"unknown line operator {op!r}")


def predicate(
    spark: SparkSession, matchers: Iterable[Matcher], filters: Iterable[LineFilter] = ()
) -> Column:
    """All matchers and all line filters. A search needs at least one matcher."""
    matchers = list(matchers)
    if not matchers:
        raise ValueError("a search needs at least one label matcher")
    parts = [matcher_col(spark, m) for m in matchers] + [line_col(spark, f) for f in filters]
    return reduce(Column.__and__, parts)
