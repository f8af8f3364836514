from __future__ import annotations

import json
import struct

import pytest
from helpers import DAY, NOW, SECOND
from pyspark.sql import functions as F

from loomlog.functions import mapping as rules
from loomlog.operators.mapping import explode_records, map_resolved, with_record_count
from loomlog.schema import ANY_VALUE, EXPORT_BATCHES, KEY_VALUES


def column_values(spark, cases, schema, column):
    rows = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], "i int, " + schema)
    return [r.out for r in rows.select("i", column.alias("out")).orderBy("i").collect()]


def value(**fields):
    return tuple(fields.get(name) for name in ANY_VALUE.names)


def test_severity_ranges_and_fallback(spark):
    cases = [(1, "x"), (4, ""), (5, ""), (8, ""), (9, ""), (12, ""), (13, ""), (16, ""), (17, ""),
             (20, ""), (21, ""), (24, ""), (0, "warning"), (-3, "straße"), (25, ""), (None, None)]
    got = column_values(spark, cases, "n int, t string", rules.severity_col(F.col("n"), F.col("t")))
    assert got == ["TRACE", "TRACE", "DEBUG", "DEBUG", "INFO", "INFO", "WARN", "WARN", "ERROR",
                   "ERROR", "FATAL", "FATAL", "WARNING", "STRASSE", "UNSPECIFIED", "UNSPECIFIED"]


TIMES = [
    # own, observed, resolved, rejected
    (NOW - 60 * SECOND, 0, NOW - 60 * SECOND, False),
    (NOW - 40 * DAY, NOW - 5 * SECOND, NOW - 5 * SECOND, True),
    (NOW + 7200 * SECOND, NOW, NOW, True),
    (NOW - 365 * DAY, NOW - 365 * DAY, NOW, True),
    (0, NOW - SECOND, NOW - SECOND, False),
    (0, 123, NOW, False),
    (0, 0, NOW, False),
    (None, None, NOW, False),
    (NOW - 30 * DAY, 0, NOW - 30 * DAY, False),
    (NOW - 30 * DAY - 1, 0, NOW, True),
    (NOW + 3600 * SECOND, 0, NOW + 3600 * SECOND, False),
    (NOW + 3600 * SECOND + 1, 0, NOW, True),
    (2**63 - 1, 0, NOW, True),
]


@pytest.mark.parametrize("as_column", [False, True])
def test_event_time(spark, as_column):
    now = F.lit(NOW).cast("bigint") if as_column else NOW
    cases = [case[:2] for case in TIMES]
    schema = "t bigint, o bigint"
    ts = rules.event_time_col(F.col("t"), F.col("o"), now)
    assert column_values(spark, cases, schema, ts) == [case[2] for case in TIMES]
    clamped = rules.clamped_col(F.col("t"), now)
    assert column_values(spark, cases, schema, clamped) == [case[3] for case in TIMES]


def test_ids(spark):
    cases = [(b"\xab" * 16,), (b"\xab" * 15,), (b"\0" * 16,), (None,), (b"\0" * 15 + b"\1",)]
    got = column_values(spark, cases, "b binary", rules.hex_id_col(F.col("b"), 16))
    assert got == ["ab" * 16, "", "", "", "0" * 31 + "1"]


VALUES = [
    ({"string_value": "hi"}, "hi"),
    ({"string_value": ""}, ""),
    ({"bool_value": True}, "true"),
    ({"int_value": -7}, "-7"),
    ({"double_value": 1.5}, "1.5"),
    ({"double_value": 1.0}, "1"),
    ({"double_value": -0.0}, "-0"),
    ({"double_value": 1e21}, "1" + "0" * 21),
    ({"double_value": 1.25e7}, "12500000"),
    ({"double_value": 12345678.75}, "12345678.75"),
    ({"double_value": 1e-7}, "0.0000001"),
    ({"double_value": -1.5e-5}, "-0.000015"),
    ({"double_value": 1.7976931348623157e308}, "17976931348623157" + "0" * 292),
    ({"double_value": float("inf")}, "inf"),
    ({"double_value": float("-inf")}, "-inf"),
    ({"double_value": float("nan")}, "NaN"),
    ({"bytes_value": b"\xde\xad"}, "dead"),
    ({"json_value": '[1, "x"]'}, '[1,"x"]'),
    ({"json_value": '{"inner": [false]}'}, '{"inner":[false]}'),
    ({"json_value": '{"b":1,"a":2.0,"b":3}'}, '{"a":2.0,"b":3}'),
    ({"json_value": '["1.0", "\\u0001num:2", 1e21, "a\\"5\\"b", null]'},
     '["1.0","\\u0001num:2",1e21,"a\\"5\\"b",null]'),
    ({}, ""),
]


def test_value_texts(spark):
    cases = [(value(**fields),) for fields, _ in VALUES]
    rows = spark.createDataFrame(
        [(i, case[0]) for i, case in enumerate(cases)],
        "i int, v " + ANY_VALUE.simpleString(),
    )
    texts = rows.select("i", rules.any_value_col("v").alias("t")).orderBy("i")
    got = [r.t for r in texts.collect()]
    want = [text for _, text in VALUES]
    # A string that starts with the number marker is the one shape that is not kept.
    marker = next(i for i, text in enumerate(want) if "num:" in text)
    assert got[:marker] + got[marker + 1:] == want[:marker] + want[marker + 1:]


def test_doubles_keep_their_value(spark):
    import random

    random.seed(7)
    doubles = [struct.unpack("d", random.randbytes(8))[0] for _ in range(400)]
    doubles = [d for d in doubles if d == d and abs(d) != float("inf")]
    rows = spark.createDataFrame([(d,) for d in doubles], "d double")
    for row in rows.select("d", rules.double_text_col("d").alias("t")).collect():
        assert float(row.t) == row.d
        assert "E" not in row.t and "e" not in row.t and not row.t.endswith(".0")


def test_long_nested_value(spark):
    nested = {"text": 'a\\"b\n' * 50_000, "n": 1}
    rows = spark.createDataFrame([(json.dumps(nested),)], "j string")
    text = rows.select(rules.nested_text_col("j").alias("t")).first().t
    assert json.loads(text) == nested


def kv(key, **fields):
    return (key, value(**fields))


def test_flatten_last_value_wins_and_keys_are_sorted(spark):
    lists = [
        [kv("z", string_value="1"), kv("a", string_value="2"), kv("z", string_value="3")],
        [kv("z", string_value="9"), kv("a", int_value=2), kv("z", bool_value=False)],
        [("none", None), (None, value(string_value="x"))],
        [kv("k", string_value="\x01")],
        [],
        None,
    ]
    want = [{"a": "2", "z": "3"}, {"a": "2", "z": "false"}, {"": "x", "none": ""}, {"k": "\x01"},
            {}, {}]
    rows = spark.createDataFrame(
        [(i, pairs) for i, pairs in enumerate(lists)], "i int, p " + KEY_VALUES.simpleString()
    )
    got = rows.select("i", rules.flatten_kvs_col("p").alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == want
    assert all(list(r.m) == sorted(r.m) for r in got)
    # The pipeline takes another way for lists of text values; the result is the same.
    batches = [(str(i), [record(attributes=pairs)]) for i, pairs in enumerate(lists)]
    mapped = map_resolved(tenant_batches(spark, batches), NOW).orderBy("body").collect()
    assert [r.attrs for r in mapped] == want
    assert all(list(r.attrs) == sorted(r.attrs) for r in mapped)


def record(time=NOW, **fields):
    names = ("time_unix_nano", "observed_time_unix_nano", "severity_number", "severity_text",
             "trace_id", "span_id", "body", "attributes")
    return tuple({"time_unix_nano": time, **fields}.get(name) for name in names)


def tenant_batches(spark, batches):
    """Batches of one resource; the body of each record is the batch's name."""
    body = [n for n in range(8)][6]
    rows = []
    for name, records in batches:
        named = [(*r[:body], value(string_value=name), *r[body + 1:]) for r in records]
        rows.append((name, None, None, [((None,), [(named,)])]))
    return spark.createDataFrame(rows, EXPORT_BATCHES).withColumn("tenant_id", F.lit("t"))


def resource_of(name):
    return ([kv("service.name", string_value=name)],) if name is not None else None


def test_resources_scopes_and_counts(spark):
    one = [record()]
    requests = [
        ("r1", None, None, [(resource_of("a"), [(one,), (one,)]), (resource_of("b"), [(one,)])]),
        ("r2", None, None, [(resource_of(None), [(one,), ([],), (None,)])]),
        ("r3", None, None, [(resource_of(""), [(one * 3,)]), (resource_of("x"), None)]),
        ("r4", None, None, []),
        ("r5", None, None, None),
    ]
    batches = spark.createDataFrame(requests, EXPORT_BATCHES)
    counts = {r.request_id: r.record_count for r in with_record_count(batches).collect()}
    assert counts == {"r1": 3, "r2": 1, "r3": 3, "r4": 0, "r5": 0}
    rows = explode_records(batches, "request_id").collect()
    services = sorted((r.request_id, r.service) for r in rows)
    assert services == [("r1", "a"), ("r1", "a"), ("r1", "b"), ("r2", "unknown")] + [("r3", "")] * 3
    assert all(r.resource == {"service.name": "a"} for r in rows if r.service == "a")


def test_missing_fields_of_a_json_batch(spark, tmp_path):
    from loomlog.operators.mapping import map_batches
    from loomlog.sources.export import read_export_batches

    line = {"request_id": "q", "x_api_key": "k", "resource_logs": [
        {"scope_logs": [{"log_records": [{}, {"body": {"int_value": 5}}]}]}]}
    (tmp_path / "in.json").write_text(json.dumps(line) + "\n{broken\n")
    batches = read_export_batches(spark, str(tmp_path))
    assert sorted(r.readable for r in batches.collect()) == [False, True]
    keys = spark.createDataFrame(
        [("1", "k", "t")], "id string, k string, tenant_id string"
    ).select("id", rules.key_hash_col(F.col("k")).alias("key_hash"), "tenant_id",
             F.current_timestamp().alias("created_at"),
             F.lit(None).cast("timestamp").alias("revoked_at"))
    rows = map_batches(batches, keys, NOW).orderBy("body").collect()
    assert [r.body for r in rows] == ["", "5"]
    first = rows[0].asDict()
    assert first == {"tenant_id": "t", "ts": NOW, "severity": "UNSPECIFIED", "service": "unknown",
                     "trace_id": "", "span_id": "", "body": "", "attrs": {}, "resource": {}}


def test_arrival_time_stands_for_now(spark):
    batches = tenant_batches(spark, [("r", [record(time=0)])])
    rows = map_resolved(batches.withColumn("arrived", F.lit(NOW - 5)), F.col("arrived"), True)
    assert [(r.ts, r.clamped) for r in rows.collect()] == [(NOW - 5, False)]
