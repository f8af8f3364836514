from __future__ import annotations

import math
from collections import Counter, defaultdict

from helpers import NOW, SECOND, log_row
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.operators import aggregates
from loomlog.operators.dedup import checksums, dedup, diff_stored, diff_tables, with_fingerprint
from loomlog.schema import LOGS


def nearest_rank(values, p):
    values = sorted(values)
    return values[math.floor((len(values) - 1) * p + 0.5)] if values else 0


groups = st.sampled_from(["a", "b", None])
numbers = st.one_of(
    st.integers(0, 20), st.integers(2**21 - 3, 2**21 + 3), st.integers(2**42 - 3, 2**42 + 3),
    st.integers(-5, 2**63 - 1),
)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(groups, numbers), min_size=1, max_size=60))
def test_latency_summary_is_exact(spark, rows):
    frame = spark.createDataFrame(rows, "g string, v bigint")
    by_group = defaultdict(list)
    for group, number in rows:
        by_group[group].append(number)
    got = aggregates.latency_summary(frame, "v", ["g"], (0.0, 0.5, 0.9, 0.99, 1.0)).collect()
    assert len(got) == len(by_group)
    for row in got:
        values = by_group[row.g]
        assert (row.n, row.max) == (len(values), max(values))
        assert [row.p0, row.p50, row.p90, row.p99, row.p100] == [
            nearest_rank(values, p) for p in (0.0, 0.5, 0.9, 0.99, 1.0)
        ]
    everything = aggregates.latency_summary(frame, "v").first()
    assert everything.p50 == nearest_rank([v for _, v in rows], 0.5)


def test_latency_of_nothing(spark):
    row = aggregates.latency_summary(spark.createDataFrame([], "v bigint"), "v").first()
    assert row.asDict() == {"n": 0, "p50": 0, "p99": 0, "max": 0}


def test_histogram_counts_every_bound(spark):
    frame = spark.createDataFrame([(v,) for v in (1, 5, 5, 9, 100)], "v bigint")
    got = aggregates.duration_histogram(frame, "v", (50, 5, 0)).collect()
    assert [(r.le, r["count"]) for r in got] == [("0", 0), ("5", 3), ("50", 4), ("+Inf", 5)]


def test_throughput_without_time_or_rows(spark):
    schema = "arrived_ns bigint, status int, rows bigint"
    one = aggregates.throughput(spark.createDataFrame([(5, 200, 3)], schema)).first()
    assert one.requests == 1 and one.elapsed_s is None and one.share_429 == 0.0
    none = aggregates.throughput(spark.createDataFrame([], schema)).first()
    assert none.requests == 0 and none.share_429 is None
    two = spark.createDataFrame([(0, 200, 3), (2 * SECOND, 429, 7)], schema)
    row = aggregates.throughput(two).first()
    assert (row.accepted_per_s, row.attempted_per_s, row.share_429) == (1.5, 5.0, 0.5)


def test_reconcile_shows_one_sided_groups(spark):
    took = spark.createDataFrame([("a", 3), ("a", 4), ("b", 1)], "tenant_id string, rows bigint")
    kept = spark.createDataFrame([log_row("a")] * 7 + [log_row("c")], LOGS)
    got = {r.tenant_id: (r.accepted, r.stored, r.difference)
           for r in aggregates.reconcile(took, kept).collect()}
    assert got == {"a": (7, 7, 0), "b": (1, 0, 1), "c": (0, 1, -1)}


def test_dashboard_aggregates(spark):
    rows = [log_row("a", NOW + i, "INFO" if i % 3 else "WARN", f"s{i % 4}") for i in range(20)]
    frame = spark.createDataFrame(rows, LOGS)
    top = aggregates.top_services(frame, 2).collect()
    assert [(r.service, r["count"]) for r in top] == [("s0", 5), ("s1", 5)]
    over = aggregates.severity_over_time(frame, NOW, NOW + 19, 10, tenant="a").collect()
    want = Counter((r[1] - r[1] % 10, r[2]) for r in rows)
    assert [((r.time, r.severity), r.c) for r in over] == sorted(want.items())


def test_equal_rows_whatever_the_map_order(spark):
    one = log_row("a", attrs={"x": "1", "y": "2"})
    other = log_row("a", attrs={"y": "2", "x": "1"})
    frame = spark.createDataFrame([one, other, log_row("b")], LOGS)
    assert dedup(frame).count() == 2
    assert with_fingerprint(frame).select("fingerprint").distinct().count() == 2
    left = spark.createDataFrame([one, one, log_row("b")], LOGS)
    right = spark.createDataFrame([other, log_row("c")], LOGS)
    got = {r.tenant_id: r.surplus for r in diff_tables(left, right).collect()}
    assert got == {"a": 1, "b": 1, "c": -1}
    assert diff_tables(left, left).count() == 0


def shuffled_rows(frame) -> list[int]:
    """Rows that each shuffle of the frame wrote, by its own metric."""
    frame.collect()
    written, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return written


def test_equal_stored_tables_shuffle_sums_only(spark):
    rows = [(i, f"t{i % 3}", {"b": str(i), "a": "x"}, None if i % 5 else 1.5) for i in range(3000)]
    schema = "id bigint, tenant string, attrs map<string,string>, part double"
    left = spark.createDataFrame(rows, schema).repartition(3)
    other = [(i, t, dict(reversed(a.items())), p) for i, t, a, p in reversed(rows)]  # maps in another order
    right = spark.createDataFrame(other, schema).repartition(5)
    assert diff_stored(left, right).count() == 0
    assert shuffled_rows(checksums(left, 16))[0] <= 16 * 3  # the other is that of `left` itself
    same = diff_stored(left, right, ranges=16)
    assert same.columns == [*left.columns, "surplus"] and sum(shuffled_rows(same)) == 0


def test_planted_differences_are_found(spark):
    rows = [(i, None if i == 7 else f"t{i % 3}", {"k": str(i)}) for i in range(2000)]
    schema = "id bigint, tenant string, attrs map<string,string>"
    changed = [(i, "" if i == 7 else t, {"k": "other"} if i == 500 else a) for i, t, a in rows if i != 900]
    left, right = spark.createDataFrame(rows, schema), spark.createDataFrame(changed + [rows[3], rows[3]], schema)
    found = diff_stored(left, right)
    got = sorted((r.id, r.tenant or "-", r.attrs["k"], r.surplus) for r in found.collect())
    assert got == [
        (3, "t0", "3", -2), (7, "-", "7", -1), (7, "-", "7", 1), (500, "t2", "500", 1), (500, "t2", "other", -1), (900, "t0", "900", 1),
    ]
    assert max(shuffled_rows(found)) < 100  # rows of the ranges that differ
    assert diff_stored(left, left.limit(0)).count() == 2000 and diff_stored(left.limit(0), left.limit(0)).count() == 0


def test_only_unequal_rows_are_shuffled_where_all_ranges_differ(spark):
    schema = "id bigint, body string"
    rows = [(i % 1500, f"text {i % 1500}") for i in range(2000)]  # some stand twice
    left = spark.createDataFrame(rows, schema)
    right = spark.createDataFrame([(i, f"{b}!" if i % 100 == 99 else b) for i, b in rows] + [rows[0]], schema)
    found = diff_stored(left, right, ranges=4)
    want = diff_tables(left, right)
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0
    assert max(shuffled_rows(found)) < 100  # the four ranges hold all rows
