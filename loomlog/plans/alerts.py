"""Published alert rules as windowed rates. Batch and stream use the same plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import latency_summary

WINDOW = "5 minutes"


def _window_bounds(window: Column) -> list[Column]:
    return [
        F.unix_micros(window["start"]).alias("window_start_us"),
        F.unix_micros(window["end"]).alias("window_end_us"),
    ]


def _sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def alert_rates(
    events: DataFrame,
    window: str = WINDOW,
    slide: str | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """Per window: rows dropped by reason, clamped stamps, share of 429, query 5xx.

    `events` has `at` (timestamp), `source` (ingest or query), `status`,
    `rows`, `drop_reason`, `clamped`. A rule with any value above zero fires.
    Sums combine before the shuffle, which carries one row per task and window.
    """
    if watermark:
        events = events.withWatermark("at", watermark)
    return rates_of_sums(alert_sums(events, window, slide))


def alert_sums(events: DataFrame, window: str = WINDOW, slide: str | None = None) -> DataFrame:
    """The sums behind `alert_rates` per window `w`; sums of parts add up to the whole's."""
    spans = F.window("at", window, slide) if slide else F.window("at", window)
    reason, rows = F.col("drop_reason"), F.col("rows")
    ingest = F.col("source") == "ingest"
    failed = (F.col("source") == "query") & F.col("status").between(500, 599)
    return events.groupBy(spans.alias("w")).agg(
        _sum_where(reason == "flush_error", rows).alias("flush_error_rows"),
        _sum_where(reason == "flush_panic", rows).alias("flush_panic_rows"),
        _sum_where(reason == "buffer_full", rows).alias("buffer_full_rows"),
        F.sum("clamped").alias("clamped_rows"),
        _sum_where(failed, F.lit(1)).alias("query_5xx"),
        _sum_where(ingest & (F.col("status") == 429), F.lit(1)).alias("refused"),
        _sum_where(ingest, F.lit(1)).alias("requests"),
    )


def rates_of_sums(sums: DataFrame) -> DataFrame:
    share = F.col("refused").cast("double") / F.nullif(F.col("requests"), F.lit(0)).cast("double")
    return sums.select(
        *_window_bounds(F.col("w")),
        "flush_error_rows",
        "flush_panic_rows",
        "buffer_full_rows",
        "clamped_rows",
        "query_5xx",
        F.coalesce(share, F.lit(0.0)).alias("share_429"),
        ((F.col("flush_error_rows") > 0) | (F.col("flush_panic_rows") > 0)).alias("data_loss"),
        (F.col("buffer_full_rows") > 0).alias("backpressure"),
        (F.col("query_5xx") > 0).alias("query_errors"),
    )


#: How partial sums of one window become one: the columns of `alert_sums`.
RATE_MERGES = {
    name: F.sum
    for name in (
        "flush_error_rows", "flush_panic_rows", "buffer_full_rows", "clamped_rows", "query_5xx", "refused", "requests",
    )
}

#: Size of a quantile sketch: its ranks are off by about 0.7 % of a window's rows.
SKETCH_SIZE = 400


def flush_sketches(events: DataFrame, window: str = WINDOW, k: int = SKETCH_SIZE) -> DataFrame:
    """Per window `w`: number and maximum of `flush_us`, and a quantile sketch that merges."""
    return (
        events.where(F.col("flush_us").isNotNull())
        .groupBy(F.window("at", window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.max("flush_us").alias("max"),
            F.kll_sketch_agg_bigint("flush_us", F.lit(k)).alias("sketch"),
        )
    )


#: The columns of `flush_sketches`.
SKETCH_MERGES = {
    "n": F.sum, "max": F.max, "sketch": lambda name: F.kll_merge_agg_bigint(name, F.lit(SKETCH_SIZE)),
}


def p99_of_sketches(sketches: DataFrame) -> DataFrame:
    """p99 per window, within the sketch's error of rank; `n` and `max` are exact."""
    p99 = F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.99).cast("double"))
    return sketches.select(*_window_bounds(F.col("w")), "n", p99.alias("p99"), "max")


def flush_p99(events: DataFrame, window: str = WINDOW) -> DataFrame:
    """Exact p99 of `flush_us` per window, on a table."""
    summary = latency_summary(
        events, "flush_us", by=[F.window("at", window)["start"].alias("start")],
        percentiles=(0.99,),
    )
    return summary.select(
        F.unix_micros("start").alias("window_start_us"), "n", "p99", "max"
    )


def flush_p99_approx(
    events: DataFrame, window: str = WINDOW, watermark: str = "1 minute", accuracy: int = 10_000
) -> DataFrame:
    """p99 of `flush_us` per window on a stream, off by at most 1/accuracy of the ranks."""
    return (
        events.withWatermark("at", watermark)
        .groupBy(F.window("at", window).alias("w"))
        .agg(
            F.count("flush_us").alias("n"),
            F.percentile_approx("flush_us", 0.99, accuracy).alias("p99"),
            F.max("flush_us").alias("max"),
        )
        .select(*_window_bounds(F.col("w")), "n", "p99", "max")
    )


def flush_counts(events: DataFrame, window: str = WINDOW) -> DataFrame:
    """How often each `flush_us` stands in each window, on a stream or table."""
    counts = events.groupBy(F.window("at", window).alias("w"), "flush_us").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select(*_window_bounds(F.col("w")), "flush_us", "n")


def flush_p99_of_counts(counts: DataFrame) -> DataFrame:
    """Exact p99 per window from `flush_counts`."""
    by = ["window_start_us", "window_end_us"]
    return latency_summary(counts, "flush_us", by=by, percentiles=(0.99,), times="n")
