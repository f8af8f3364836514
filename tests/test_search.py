from __future__ import annotations

import json
import re

import pytest
from helpers import NOW, SECOND, log_row
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlog.functions.patterns import full_match, java_pattern, search_match
from loomlog.operators.checks import isolation_violations
from loomlog.operators.filters import in_range, line_col, matcher_col
from loomlog.operators.ordering import check_limit, is_forward, latest_logs
from loomlog.plans import search
from loomlog.schema import LOGS, RESULT_COLUMNS

RANGE = {"start": NOW - 3600 * SECOND, "end": NOW + SECOND}


def count(rows, tenant, matchers, filters=()):
    return len(search.log_query(rows, tenant, matchers, filters, **RANGE).collect())


def test_seed_rows(seed_rows):
    assert count(seed_rows, "a", [("service", "=", "ledger")]) == 2
    assert count(seed_rows, "b", [("service", "=", "ledger")]) == 1
    assert count(seed_rows, "a", [("severity", "=~", "ERR.*")]) == 1
    assert count(seed_rows, "a", [("env", "=", "lab")]) == 2
    assert count(seed_rows, "a", [("region", "=", "north-3")]) == 2
    assert count(seed_rows, "a", [("service", "=", "ledger")], [("|=", "period")]) == 1
    assert count(seed_rows, "a", [("service", "=", "ledger")], [("|~", "book")]) == 1
    assert count(seed_rows, "a", [("missing", "!=", "x")]) == 2
    assert count(seed_rows, "a", [("missing", "=", "")]) == 2
    assert count(seed_rows, "a", [("tenant_id", "=", "b")]) == 0


def test_result_shape_order_and_limit(seed_rows):
    rows = search.log_query(seed_rows, "a", [("service", "=~", ".+")], **RANGE)
    assert tuple(rows.columns) == RESULT_COLUMNS
    assert [r.severity for r in rows.collect()] == ["INFO", "ERROR"]
    oldest = search.log_query(
        seed_rows, "a", [("service", "=~", ".+")], direction="FORWARD", limit=0, **RANGE
    )
    assert [r.severity for r in oldest.collect()] == ["ERROR"]
    assert [check_limit(n) for n in (0, 1, 100, 5000)] == [1, 1, 100, 5000]
    assert check_limit(9999, None) == 9999 and check_limit(None, None) is None
    for refused in (9999, None):
        with pytest.raises(ValueError, match="ceiling"):
            check_limit(refused)
    assert not is_forward(None) and not is_forward("") and is_forward("Forward")
    with pytest.raises(ValueError):
        is_forward("sideways")


def test_arguments_that_are_refused(seed_rows):
    with pytest.raises(ValueError):
        search.log_query(seed_rows, "a", [], **RANGE)
    with pytest.raises(ValueError):
        search.log_query(seed_rows, "a", [("service", "=~", "(")], **RANGE)
    with pytest.raises(ValueError):
        search.log_query(seed_rows, "a", [("service", "<", "x")], **RANGE)
    with pytest.raises(ValueError):
        search.trace_lookup(seed_rows, "a", "A" * 32)
    with pytest.raises(ValueError):
        search.trace_lookup(seed_rows, "a", "a" * 32, start=1)


def test_trace_lookup_and_isolation(seed_rows):
    trace = "5a" * 16
    found = search.trace_lookup(seed_rows, "a", trace)
    assert [(r.trace_id, r.attrs, r.resource) for r in found.collect()] == [
        (trace, {"env": "lab"}, {"region": "north-3"})
    ]
    assert search.trace_lookup(seed_rows, "b", trace).count() == 0
    assert search.trace_lookup(seed_rows, "a", trace, NOW - 1, NOW + 1).count() == 0
    assert isolation_violations(seed_rows, "a", found).count() == 0
    assert isolation_violations(seed_rows, "b", found).count() == 1


def test_label_lists(spark, seed_rows):
    row = spark.createDataFrame([log_row("c", service="billing", severity="WARN")], LOGS)
    values = search.label_values(row, "service", "c", **RANGE).collect()
    assert [r.value for r in values] == ["billing"]
    assert search.label_values(row, "env", "c", **RANGE).collect() == []
    names = {(r.label, r.source): r.rows for r in search.label_names(seed_rows, "a", **RANGE).collect()}
    assert names == {("service", "column"): 2, ("severity", "column"): 2, ("env", "attrs"): 2,
                     ("region", "resource"): 2}
    fixed = search.label_names(seed_rows, "a", fixed_only=True, **RANGE).collect()
    assert sorted(r.label for r in fixed) == ["service", "severity"]


def test_streams(spark):
    rows = spark.createDataFrame(
        [log_row("a", NOW + i, "INFO", f"s{i % 2}", body=str(i)) for i in range(5)], LOGS
    )
    back = search.log_query_range(
        rows, "a", [("service", "=~", "s.*")], limit=4, now_ns=NOW + 10
    ).collect()
    assert [(r.service, [v[1] for v in r["values"]]) for r in back] == [
        ("s0", ["4", "2"]), ("s1", ["3", "1"])
    ]
    assert back[0]["values"][0][0] == str(NOW + 4)
    forward = search.log_query_instant(
        rows, "a", [("service", "=~", "s.*")], at=NOW + 4, direction="forward"
    ).collect()
    assert [[v[1] for v in r["values"]] for r in forward] == [["0", "2"], ["1", "3"]]


def test_rows_as_json(spark):
    rows = spark.createDataFrame(
        [log_row("a", 42, "ERROR", "api", "abc", "def", 'bo"om\n', {"k": "v", "b": ""})], LOGS
    )
    text = search.rows_as_json(rows.select(*RESULT_COLUMNS)).first().json
    assert json.loads(text) == {
        "ts": 42, "severity": "ERROR", "service": "api", "trace_id": "abc", "span_id": "def",
        "body": 'bo"om\n', "attrs": {"k": "v", "b": ""}, "resource": {},
    }
    assert list(json.loads(text)) == sorted(json.loads(text))


MATCHES = [
    # text, pattern, whole text matches, occurs in text
    ("abc", "abc", True, True),
    ("abc\n", "abc", False, True),
    ("abc\n", "abc$", False, False),
    ("abc\n", "(?m)c$", False, True),
    ("a\nb", "a.b", True, True),
    ("a\nb", "(?-s)a.b", False, False),
    ("a\rb", "(?-s)a.b", True, True),
    ("ÉTÉ", "(?i)été", True, True),
    ("x1y", "[[:alpha:]][[:digit:]]y", True, True),
    ("a[b", "a[[]b", True, True),
    ("a&b", "a[&&]b", True, True),
    ("a.b", r"a\.b", True, True),
    ("aéb", r"a\b.*", True, True),
    ("a\x0bb", r"a\sb", False, False),
    ("cost 5$", r"cost 5\$", True, True),
    ("b", "a|b|", True, True),
    ("", "a|b|", True, True),
    ("prefix\nrest", "prefix.*", True, True),
    ("", ".+", False, False),
    ("", ".*", True, True),
    ("svc-error", "svc-(error|view)", True, True),
    ("é1", r"\w1", False, False),
    ("named", "(?P<n>na)med", True, True),
]


def test_patterns(spark):
    for text, pattern, whole, part in MATCHES:
        row = spark.createDataFrame([(text,)], "t string").select(
            full_match(spark, F.col("t"), pattern).alias("whole"),
            search_match(spark, F.col("t"), pattern).alias("part"),
        ).first()
        assert (row.whole, row.part) == (whole, part), (text, pattern)


@pytest.mark.parametrize("pattern", ["(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", r"(a)\1", "a++", "a*+"])
def test_backtracking_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        java_pattern(pattern)


words = st.text("ab1.-\n$é ", max_size=4)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(words, words, words), min_size=1, max_size=40), words)
def test_filters_partition_the_rows(spark, texts, wanted):
    rows = spark.createDataFrame(
        [log_row("a", NOW + i, body=b, attrs={"x": a} if i % 2 else {}, resource={"x": r})
         for i, (b, a, r) in enumerate(texts)],
        LOGS,
    ).cache()
    total = rows.count()

    def n(condition):
        return rows.filter(condition).count()

    equal = n(matcher_col(spark, ("x", "=", wanted)))
    assert equal + n(matcher_col(spark, ("x", "!=", wanted))) == total
    assert equal == sum((a if i % 2 else r) == wanted for i, (_, a, r) in enumerate(texts))
    escaped = re.sub(r"([.$-])", r"\\\1", wanted)
    assert n(matcher_col(spark, ("x", "=~", escaped))) == equal
    assert n(matcher_col(spark, ("x", "!~", escaped))) == total - equal
    inside = n(line_col(spark, ("|=", wanted)))
    assert inside == sum(wanted in b for b, _, _ in texts)
    assert inside + n(line_col(spark, ("!=", wanted))) == total
    assert n(line_col(spark, ("|~", escaped))) == inside
    assert n(line_col(spark, ("!~", escaped))) == total - inside
    middle = NOW + len(texts) // 2
    low, high = NOW, NOW + len(texts)
    assert in_range(rows, low, middle).count() + in_range(rows, middle, high).count() == total
    rows.unpersist()


def test_ties_are_ordered(spark):
    rows = spark.createDataFrame([log_row("a", NOW, span=s) for s in "cabd"], LOGS)
    assert [r.span_id for r in latest_logs(rows, 3).collect()] == ["a", "b", "c"]
    assert [r.span_id for r in latest_logs(rows, 3, "forward").collect()] == ["a", "b", "c"]


def test_patterns_on_long_texts_and_odd_escapes(spark):
    """Repeated groups don't recurse, flags and escapes mean what the dialect says."""
    long = "word " * 3_300_000 + "end."
    frame = spark.createDataFrame([(1, long), (2, "x\n"), (3, "(?m x"), (4, "x\x0b"), (5, None)], "i int, body string")
    matched = lambda p: {r.i for r in frame.filter(line_col(spark, ("|~", p))).select("i").collect()}
    assert matched(r"(?:[a-z]|\s)+\.$") == {1}
    assert matched(r"x\v") == {4}
    assert matched(r"(?-m)x$|\(?m") == {1, 3} - {1}
    assert matched(r"(?i)WORD(\s|$)") == {1}
    for bad in (r"\Z", r"\h", r"\R", r"\G", "(", r"(?=x)", r"\1"):
        with pytest.raises(ValueError):
            line_col(spark, ("|~", bad))


def test_isolation_check_finds_leaks(spark, seed_rows):
    """A row of the other tenant with equal ids, a row of no table, a row returned twice."""
    twin = log_row("b", NOW, "INFO", trace="c7" * 16, span="c7" * 8, body="posting 18 booked", attrs={"env": "secret"})
    logs = seed_rows.unionByName(spark.createDataFrame([twin], LOGS))
    own = logs.filter("tenant_id = 'a'").select(*RESULT_COLUMNS)
    leak = logs.filter("attrs['env'] = 'secret'").select(*RESULT_COLUMNS)
    unknown = spark.createDataFrame([log_row(body="nowhere")], LOGS).select(*RESULT_COLUMNS)
    assert isolation_violations(logs, "a", own).count() == 0
    for more, body in ((leak, "posting 18 booked"), (unknown, "nowhere"), (own.limit(1), None)):
        found = isolation_violations(logs, "a", own.unionByName(more)).collect()
        assert len(found) == 1 and found[0].surplus == 1
        assert body is None or found[0].body == body


def test_label_values_of_maps_and_wide_ranges(seed_rows):
    values = lambda **more: [r.value for r in search.label_values(seed_rows, "env", "a", **RANGE, **more).collect()]
    assert values() == [] and values(in_maps=True) == ["lab"]
    with pytest.raises(ValueError, match="wider"):
        search.log_query(seed_rows, "a", [("env", "=", "lab")], start=0, end=NOW, now_ns=NOW)
    wide = search.log_query(seed_rows, "a", [("env", "=", "lab")], start=0, end=NOW + 1, now_ns=NOW, widest=None)
    assert wide.count() == 2
