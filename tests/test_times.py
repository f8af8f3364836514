from __future__ import annotations

import datetime as dt

import pytest
from helpers import DAY, NOW, SECOND
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlog.functions import times
from loomlog.functions.mapping import NANOS_MAX, NANOS_MIN

TEXTS = {
    "1234567890": 1_234_567_890 * SECOND,
    "12345678901": 12_345_678_901,
    "1700000000000000000": 1_700_000_000_000_000_000,
    "1.5": 1_500_000_000,
    "-1.5": -1_500_000_000,
    ".5": 500_000_000,
    "5.": 5 * SECOND,
    "1.5e3": 1500 * SECOND,
    "+7": 7 * SECOND,
    "0000000000012": 12 * SECOND,
    "9999999999": NANOS_MAX,
    "-9999999999": NANOS_MIN,
    "1.0e300": NANOS_MAX,
    "-1.0e300": NANOS_MIN,
    "2026-01-01T00:00:00Z": 1_767_225_600 * SECOND,
    "2026-01-01t00:00:00.123456789z": 1_767_225_600 * SECOND + 123_456_789,
    "2026-01-01T00:00:00.1+05:30": (1_767_225_600 - 19_800) * SECOND + 100_000_000,
    "1969-12-31T23:59:59.5Z": -500_000_000,
    "not-a-time": None,
    "": None,
    " 5": None,
    "5\n": None,
    "1.2.3": None,
    "2026-02-30T00:00:00Z": None,
    "2026-01-01": None,
    "99999999999999999999": None,
    "1e5": None,
}


def test_time_texts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t: r.ns for r in rows.select("t", times.nanos_col(F.col("t")).alias("ns")).collect()}
    assert got == TEXTS


@pytest.mark.parametrize("text", TEXTS)
def test_time_text_on_the_driver(text):
    if TEXTS[text] is None:
        with pytest.raises(ValueError):
            times.to_nanos(text)
    else:
        assert times.to_nanos(text) == TEXTS[text]


def test_json_numbers(spark):
    cases = {"42": 42 * SECOND, "2.0": 2 * SECOND, "-1e300": NANOS_MIN, "1e3": 1000 * SECOND,
             "1700000000000000000": 1_700_000_000_000_000_000,
             "18446744073709551615": None, "2026-01-01T00:00:00Z": None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    column = times.nanos_col(F.col("t"), json_number=True).alias("ns")
    assert {r.t: r.ns for r in rows.select("t", column).collect()} == cases
    assert times.to_nanos(2.0) == 2 * SECOND and times.to_nanos(-1e300) == NANOS_MIN


HOUR = times.DEFAULT_RANGE_NS
RANGES = [
    ((None, 10 * HOUR), (9 * HOUR, 10 * HOUR)),
    ((0, times.MAX_RANGE_NS), (0, times.MAX_RANGE_NS)),
    ((1000, 1000 + HOUR), (1000, 1000 + HOUR)),
    ((None, NANOS_MIN), (NANOS_MIN, NANOS_MIN)),
    ((None, None), (NOW - HOUR, NOW)),
    ((NOW + 5, NOW), (NOW + 5, NOW)),
]


def test_wide_offsets(spark):
    texts = ["2026-01-01T00:00:00+19:00", "2026-01-01T00:00:00-23:59", "2026-01-01T00:00:00+05:30"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", times.nanos_col(F.col("t")).alias("ns"))
    assert all(r.ns == times.to_nanos(r.t) and r.ns is not None for r in rows.collect())


def test_ranges(spark):
    for given_range, resolved in RANGES:
        clamped = tuple(times.clamp_nanos(v) if v is not None else None for v in given_range)
        assert times.resolve_range(*clamped, NOW) == tuple(map(times.clamp_nanos, resolved))
    with pytest.raises(ValueError, match="wider"):
        times.resolve_range(0, times.MAX_RANGE_NS + 1, NOW)
    assert times.resolve_range(0, 5 * times.MAX_RANGE_NS, NOW, None) == (0, 5 * times.MAX_RANGE_NS)
    # The largest case is beyond a long and only exists on the driver.
    table = [r[0] for r in RANGES if r[0][1] is None or r[0][1] <= NANOS_MAX]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(table)], "i int, s bigint, e bigint")
    start, end = times.resolve_range_cols(F.col("s"), F.col("e"), NOW)
    got = [(r.a, r.b) for r in rows.select("i", start.alias("a"), end.alias("b")).orderBy("i").collect()]
    assert got == [times.resolve_range(*r, NOW) for r in table]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(NANOS_MIN + DAY, NANOS_MAX - DAY), min_size=1, max_size=200))
def test_day_and_bucket(spark, stamps):
    rows = spark.createDataFrame([(s,) for s in stamps], "ts bigint")
    got = rows.select(
        "ts", times.day_col(F.col("ts")).alias("day"),
        times.floor_to(F.col("ts"), 300 * SECOND).alias("bucket"),
        F.unix_micros(times.micros_col(F.col("ts"))).alias("us"),
    ).collect()
    for row in got:
        assert row.day == dt.date(1970, 1, 1) + dt.timedelta(days=row.ts // DAY)
        assert row.day == times.day_of(row.ts)
        assert row.bucket == row.ts - row.ts % (300 * SECOND)
        assert row.us == row.ts // 1000
