"""Time values: texts of mixed shape to nanoseconds, search ranges, day of a stamp."""

from __future__ import annotations

import datetime as dt
import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mapping import NANOS_MAX, NANOS_MIN, NS_PER_DAY, NS_PER_SECOND, saturating_minus

# Default search range, widest search range.
DEFAULT_RANGE_NS = 3_600 * NS_PER_SECOND
MAX_RANGE_NS = 31 * NS_PER_DAY

_RFC3339 = (
    r"\A(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d+))?([Zz]|[+-]\d\d:\d\d)\z"
)
_NUMBER_WITH_POINT = r"\A[+-]?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
_JSON_FLOAT = r"\A-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\z"
_INTEGER = r"\A[+-]?\d+\z"


def clamp_nanos(value: int) -> int:
    return max(NANOS_MIN, min(NANOS_MAX, value))


def resolve_range(
    start: int | None, end: int | None, now_ns: int, widest: int | None = MAX_RANGE_NS
) -> tuple[int, int]:
    """End defaults to now, start to one hour before it.

    A range wider than `widest` is refused, never narrowed; None allows any.
    """
    end = clamp_nanos(now_ns if end is None else end)
    start = clamp_nanos(end - DEFAULT_RANGE_NS if start is None else start)
    if widest is not None and end - start > widest:
        raise ValueError(f"a range of {end - start} ns is wider than {widest}; pass widest to change it")
    return start, end


def resolve_range_cols(
    start: Column, end: Column, now_ns: int, widest: int | None = MAX_RANGE_NS
) -> tuple[Column, Column]:
    """The defaults for a table of saved searches; here a wider range keeps its last
    `widest` nanoseconds, as a column can refuse nothing. None allows any.
    """
    end = F.coalesce(end, F.lit(now_ns).cast("bigint"))
    start = F.coalesce(start, saturating_minus(end, DEFAULT_RANGE_NS))
    return start if widest is None else F.greatest(start, saturating_minus(end, widest)), end


def day_of(ns: int) -> dt.date:
    return dt.date(1970, 1, 1) + dt.timedelta(days=ns // NS_PER_DAY)


def day_col(ts: Column) -> Column:
    """UTC day of a nanosecond stamp, in integer arithmetic (no timestamp cast)."""
    days = _div(floor_to(ts, NS_PER_DAY), NS_PER_DAY).cast("int")
    return F.date_add(F.lit(dt.date(1970, 1, 1)), days)


def floor_to(ts: Column, width_ns: int) -> Column:
    """Start of the bucket of `width_ns` that holds the stamp."""
    return ts - F.pmod(ts, F.lit(width_ns).cast("bigint"))


def micros_col(ts: Column) -> Column:
    """Spark timestamp (microseconds) of a nanosecond stamp, for windows only."""
    return F.timestamp_micros(_div(floor_to(ts, 1_000), 1_000))


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def _seconds_to_nanos(text: Column) -> Column:
    nanos = F.round(text.try_cast("double") * float(NS_PER_SECOND))
    return (
        F.when(nanos >= float(NANOS_MAX), F.lit(NANOS_MAX).cast("bigint"))
        .when(nanos <= float(NANOS_MIN), F.lit(NANOS_MIN).cast("bigint"))
        .otherwise(nanos.try_cast("bigint"))
    )


def _integer_to_nanos(number: Column) -> Column:
    limit = NANOS_MAX // NS_PER_SECOND
    return (
        F.when(~number.between(-9_999_999_999, 9_999_999_999), number)
        .when(number > limit, F.lit(NANOS_MAX).cast("bigint"))
        .when(number < -limit, F.lit(NANOS_MIN).cast("bigint"))
        .otherwise(number * F.lit(NS_PER_SECOND).cast("bigint"))
    )


def _rfc3339_to_nanos(text: Column) -> Column:
    """Spark parses to microseconds only, so the fraction is taken from the text."""
    def part(group: int) -> Column:
        return F.regexp_extract(text, _RFC3339, group)

    # The offset is taken from the text too: timestamps allow 18 hours only.
    moment = F.concat(part(1), F.lit("T"), part(2), F.lit("Z")).try_cast("timestamp")
    def ahead(offset: Column) -> Column:
        hours, minutes = (F.substring(offset, at, 2).try_cast("int") for at in (2, 5))
        away = F.when(offset.startswith("-"), -1).otherwise(1) * (hours * 3600 + minutes * 60)
        return F.when(F.upper(offset) == "Z", 0).when((hours < 24) & (minutes < 60), away)

    fraction = F.rpad(F.substring(part(3), 1, 9), 9, "0").cast("bigint")
    limit = NANOS_MAX // NS_PER_SECOND

    def nanos(seconds: Column) -> Column:
        return (
            F.when(seconds >= limit, F.lit(NANOS_MAX).cast("bigint"))
            .when(seconds < -limit, F.lit(NANOS_MIN).cast("bigint"))
            .otherwise(seconds * F.lit(NS_PER_SECOND).cast("bigint") + fraction)
        )

    # Bound by a one-element array, so that the text is taken apart once.
    seconds = F.unix_seconds(moment) - F.get(F.transform(F.array(part(4)), ahead), F.lit(0))
    return F.get(F.transform(F.array(seconds), nanos), F.lit(0))


def nanos_col(text: Column, json_number: bool = False) -> Column:
    """Nanoseconds of a time text, NULL where it is none of the known shapes.

    A number with a point is seconds; an integer of at most ten digits is
    seconds and a longer one nanoseconds; anything else must be RFC 3339. With
    `json_number` the text is a bare JSON number: an exponent makes it seconds
    too, and no date is tried.
    """
    integer = text.rlike(_INTEGER)
    number = _integer_to_nanos(text.try_cast("bigint"))
    if json_number:
        return F.when(integer, number).when(text.rlike(_JSON_FLOAT), _seconds_to_nanos(text))
    return (
        F.when(integer, number)
        .when(text.rlike(_NUMBER_WITH_POINT), _seconds_to_nanos(text))
        .when(text.rlike(_RFC3339), _rfc3339_to_nanos(text))
    )


def to_nanos(value: int | float | str | None) -> int | None:
    """The same rule for one argument on the driver; raises ValueError."""
    if value is None:
        return None
    text = value if isinstance(value, str) else repr(value)
    if re.fullmatch(r"[+-]?\d+", text):
        number = int(text)
        if NANOS_MIN <= number <= NANOS_MAX:
            short = abs(number) <= 9_999_999_999
            return clamp_nanos(number * NS_PER_SECOND) if short else number
    elif re.fullmatch(_NUMBER_WITH_POINT[2:-2], text) or isinstance(value, float):
        scaled = max(float(NANOS_MIN), min(float(NANOS_MAX), float(text) * NS_PER_SECOND))
        if scaled == scaled:  # not NaN
            return clamp_nanos(int(Decimal(scaled).to_integral_value(ROUND_HALF_UP)))
    elif found := re.fullmatch(_RFC3339[2:-2], text):
        date, clock, fraction, offset = found.groups()
        moment = dt.datetime.fromisoformat(f"{date}T{clock}{offset.upper()}")
        seconds = int(moment.timestamp())
        return clamp_nanos(seconds * NS_PER_SECOND + int((fraction or "0")[:9].ljust(9, "0")))
    raise ValueError(f"not a time value: {value!r}")
