"""Time order and row limits of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest result unless another ceiling is asked for, usual result.
MAX_LIMIT = 5000
DEFAULT_LIMIT = 100

# Rows of one instant have no order of their own; these make results repeatable.
_TIE_BREAKERS = ("span_id", "service", "severity", "body")


def is_forward(direction: str | None) -> bool:
    wanted = (direction or "backward").lower()
    if wanted not in ("forward", "backward"):
        raise ValueError(f"direction must be 'forward' or 'backward', not {direction!r}")
    return wanted == "forward"


def check_limit(limit: int | None, max_limit: int | None = MAX_LIMIT) -> int | None:
    """The limit, at least 1. One above `max_limit` is refused, never lowered.

    `max_limit=None` lifts the ceiling, and only then may `limit` be None: all rows.
    """
    if max_limit is not None and (limit is None or limit > max_limit):
        raise ValueError(f"limit {limit} is above the ceiling of {max_limit}; pass max_limit to change it")
    return None if limit is None else max(1, limit)


def time_order(direction: str | None) -> list[Column]:
    ts = F.col("ts")
    return [ts.asc() if is_forward(direction) else ts.desc(), *map(F.col, _TIE_BREAKERS)]


def latest_logs(
    logs: DataFrame,
    limit: int | None,
    direction: str | None = "backward",
    max_limit: int | None = MAX_LIMIT,
) -> DataFrame:
    """The newest (or oldest) rows: a per-partition top-k and one small merge, no sort.

    Without a limit, all rows in order.
    """
    limit, ordered = check_limit(limit, max_limit), logs.orderBy(*time_order(direction))
    return ordered if limit is None else ordered.limit(limit)
