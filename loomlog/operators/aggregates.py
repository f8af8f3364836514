"""Aggregates over log rows and over the pipeline's own request records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mapping import NS_PER_SECOND
from ..functions.times import floor_to
from .filters import in_range
from .ordering import MAX_LIMIT, is_forward, latest_logs

# Bits of a value resolved per ranking level: at most 2**21 values share a level's group.
_LEVEL_BITS = 21


def severity_over_time(
    logs: DataFrame, start: int, end: int, bucket_ns: int, tenant: str | None = None
) -> DataFrame:
    """Rows per time bucket and severity; like a dashboard range, both ends count."""
    if tenant is not None:
        logs = logs.filter(F.col("tenant_id") == tenant)
    return (
        in_range(logs, start, end + 1)
        .groupBy(floor_to(F.col("ts"), bucket_ns).alias("time"), "severity")
        .agg(F.count(F.lit(1)).alias("c"))
        .orderBy("time", "severity")
    )


def top_services(logs: DataFrame, n: int = 10, tenant: str | None = None) -> DataFrame:
    if tenant is not None:
        logs = logs.filter(F.col("tenant_id") == tenant)
    return (
        logs.groupBy("service")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "service")
        .limit(n)
    )


def count_by(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def count_by_tenant(logs: DataFrame) -> DataFrame:
    return count_by(logs, "tenant_id")


def count_by_trace(logs: DataFrame) -> DataFrame:
    return count_by(logs, "tenant_id", "trace_id")


def to_streams(
    rows: DataFrame,
    limit: int,
    direction: str | None = "backward",
    max_limit: int | None = MAX_LIMIT,
) -> DataFrame:
    """Result rows as streams: one row per (service, severity), values in time order.

    The limit is applied here, before any list is built, so a list never holds
    more than the limit; whoever lifts the ceiling answers for its length.
    """
    if is_forward(direction):
        picked = F.sort_array(F.collect_list(F.struct("ts", "span_id", "body")))
    else:
        # Descending by time only: the sort key is negated so ties still ascend.
        picked = F.sort_array(
            F.collect_list(F.struct((-F.col("ts")).alias("order"), "span_id", "body", "ts"))
        )
    values = F.transform(picked, lambda v: F.array(v["ts"].cast("string"), v["body"]))
    return (
        latest_logs(rows, limit, direction, max_limit)
        .groupBy("service", "severity")
        .agg(values.alias("values"))
        .orderBy("service", "severity")
    )


def reconcile(accepted: DataFrame, stored: DataFrame, *by: str) -> DataFrame:
    """Rows accepted against rows stored per group, with their difference.

    Both sides shrink to one row per group before the join. `accepted` holds
    `rows` per request.
    """
    by = by or ("tenant_id",)
    took = accepted.groupBy(*by).agg(F.sum("rows").alias("accepted"))
    kept = stored.groupBy(*by).agg(F.count(F.lit(1)).alias("stored"))
    zero = F.lit(0).cast("bigint")
    counts = took.join(kept, list(by), "full_outer").select(
        *by,
        F.coalesce("accepted", zero).alias("accepted"),
        F.coalesce("stored", zero).alias("stored"),
    )
    return counts.withColumn("difference", F.col("accepted") - F.col("stored"))


def requests_by_status(requests: DataFrame) -> DataFrame:
    return requests.groupBy("status").agg(F.count(F.lit(1)).alias("requests"))


def row_totals(requests: DataFrame) -> DataFrame:
    """Rows accepted (status 200) and, of those, rows that were not dropped later."""
    accepted = F.when(F.col("status") == 200, F.col("rows")).otherwise(0)
    flushed = F.when(F.col("drop_reason").isNull(), accepted).otherwise(0)
    return requests.agg(
        F.coalesce(F.sum(accepted), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum(flushed), F.lit(0)).alias("flushed"),
    )


def dropped_rows(requests: DataFrame) -> DataFrame:
    return (
        requests.filter(F.col("drop_reason").isNotNull())
        .groupBy(F.col("drop_reason").alias("reason"))
        .agg(F.sum("rows").alias("rows"))
    )


def throughput(requests: DataFrame) -> DataFrame:
    """Accepted and attempted rows per second of elapsed time, and the share of 429."""
    accepted = F.when(F.col("status") == 200, F.col("rows")).otherwise(0)
    refused = F.when(F.col("status") == 429, 1).otherwise(0)
    totals = requests.agg(
        F.sum(accepted).alias("accepted"),
        F.sum("rows").alias("attempted"),
        F.sum(refused).alias("refused"),
        F.count(F.lit(1)).alias("requests"),
        (F.max("arrived_ns") - F.min("arrived_ns")).alias("elapsed_ns"),
    )
    seconds = F.nullif(F.col("elapsed_ns"), F.lit(0)).cast("double") / float(NS_PER_SECOND)
    return totals.select(
        "requests",
        seconds.alias("elapsed_s"),
        (F.col("accepted").cast("double") / seconds).alias("accepted_per_s"),
        (F.col("attempted").cast("double") / seconds).alias("attempted_per_s"),
        (F.col("refused").cast("double") / F.nullif(F.col("requests"), F.lit(0)).cast("double"))
        .alias("share_429"),
    )


def duration_histogram(rows: DataFrame, column: str, bounds: Sequence[int]) -> DataFrame:
    """How many values are at most each bound (cumulative), and how many in all.

    One pass and one row of sums; the rows of the result come from the bounds.
    """
    def at_most(bound: int) -> Column:
        return F.coalesce(
            F.sum(F.when(F.col(column) <= bound, 1).otherwise(0)), F.lit(0)
        ).cast("bigint")

    bounds = sorted(bounds)
    sums = rows.agg(
        *[at_most(bound).alias(f"b{i}") for i, bound in enumerate(bounds)],
        F.count(column).alias("all"),
    )
    lines = [
        F.struct(F.lit(str(bound)).alias("le"), F.col(f"b{i}").alias("count"))
        for i, bound in enumerate(bounds)
    ]
    lines.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("count")))
    return sums.select(F.inline(F.array(*lines)))


def latency_summary(
    rows: DataFrame,
    column: str,
    by: Sequence[str | Column] = (),
    percentiles: Sequence[float] = (0.5, 0.99),
    times: str | None = None,
) -> DataFrame:
    """Nearest-rank percentiles and the maximum of a whole-number column, exactly.

    The value at rank `round((n - 1) * p)` of the sorted group, halves up.
    No task sorts a group: values are counted first, then ranked level by
    level on 21 bits each, so whatever the number of rows in a group, one
    window partition holds at most 2**21 entries (2**22 where values can be
    negative). With `times`, a row counts as often as that column says.
    """
    named = [F.col(c) if isinstance(c, str) else c for c in by]
    data = rows.filter(F.col(column).isNotNull()).select(
        *named,
        F.col(column).cast("bigint").alias("_v"),
        (F.col(times) if times else F.lit(1)).cast("bigint").alias("_times"),
    )
    groups = data.columns[:-2]
    counted = data.groupBy(*groups, "_v").agg(F.sum("_times").alias("_n"))
    levels = counted.select(
        *groups,
        F.shiftright("_v", 2 * _LEVEL_BITS).alias("_high"),
        F.shiftright("_v", _LEVEL_BITS).alias("_mid"),
        "_v",
        "_n",
    )
    mid_groups = [*groups, "_high", "_mid"]
    # Rows before each middle bucket: inside its high bucket, plus the high buckets before.
    mids = levels.groupBy(*mid_groups).agg(F.sum("_n").alias("_n"))
    highs = mids.groupBy(*groups, "_high").agg(F.sum("_n").alias("_n"))
    highs = highs.select(
        *groups,
        "_high",
        (_running(groups, "_high") - F.col("_n")).alias("_before_high"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("_total"),
    )
    mids = mids.select(
        *mid_groups, (_running([*groups, "_high"], "_mid") - F.col("_n")).alias("_before_mid")
    )
    offsets = _null_safe_join(mids, highs, [*groups, "_high"])
    inside = levels.select(*mid_groups, "_v", "_n", _running(mid_groups, "_v").alias("_upto"))
    ranked = _null_safe_join(inside, offsets, mid_groups).select(
        *groups,
        "_v",
        "_total",
        (F.col("_before_high") + F.col("_before_mid") + F.col("_upto")).alias("_end"),
        "_n",
    )
    wanted = []
    for p in percentiles:
        rank = F.round((F.col("_total") - 1).cast("double") * p).cast("bigint")
        hit = (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_n"))
        name = "p" + f"{p * 100:g}".replace(".", "_")
        wanted.append(F.coalesce(F.max(F.when(hit, F.col("_v"))), F.lit(0)).alias(name))
    return ranked.groupBy(*groups).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        *wanted,
        F.coalesce(F.max("_v"), F.lit(0)).alias("max"),
    )


def _running(groups: Sequence[str], order: str) -> Column:
    window = Window.partitionBy(*groups).orderBy(order)
    return F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on all of `on`, where a NULL group equals a NULL group."""
    renamed = right.select(
        *[F.col(c).alias(f"_r{c}") for c in on], *[c for c in right.columns if c not in on]
    )
    condition = F.lit(True)
    for name in on:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_r{name}"))
    return left.join(renamed, condition).drop(*[f"_r{c}" for c in on])
