"""Standard export JSON: typed trees of any depth, numbers, ids, odd lines, streams."""

from __future__ import annotations

import json
import random

import pytest
from helpers import NOW, plan_of
from pyspark.sql import functions as F

from loomlog.functions.trees import bytes_of, double_text, nested_text, tree_text
from loomlog.operators.mapping import explode_records, map_resolved
from loomlog.sources.export import read_export_batches


def request(*records, attributes=None, **beside):
    resource = {} if attributes is None else {"resource": {"attributes": attributes}}
    return json.dumps({"resourceLogs": [{**resource, "scopeLogs": [{"logRecords": list(records)}]}], **beside})


def landed(spark, tmp_path, *lines):
    path = tmp_path / "in"
    path.mkdir()
    (path / "part.json").write_text("\n".join(lines), encoding="utf-8")
    return read_export_batches(spark, str(path), "otlp_json")


def rows_of(batches):
    return map_resolved(batches.withColumn("tenant_id", F.lit("a")), NOW).collect()


@pytest.mark.parametrize(
    "tree, text",
    [
        ({"arrayValue": {"values": [{"intValue": "1"}, {"stringValue": "x"}]}}, '[1,"x"]'),
        ({"kvlistValue": {"values": [{"key": "inner", "value": {"arrayValue": {"values": [{"boolValue": False}]}}}]}}, '{"inner":[false]}'),
        ({"arrayValue": {}}, "[]"),
        ({"kvlistValue": {"values": []}}, "{}"),
        ({"kvlistValue": {"values": [{"key": "b", "value": {"intValue": 1}}, {"key": "a"}, {"key": "b", "value": {"intValue": "2"}}, {}]}}, '{"":null,"a":null,"b":2}'),
        ({"arrayValue": {"values": [{}, None, {"doubleValue": 2.0}, {"doubleValue": "NaN"}, {"doubleValue": "-Infinity"}]}}, "[null,null,2.0,null,null]"),
        ({"arrayValue": {"values": [{"bytesValue": "3q0="}, {"bytesValue": "_-8"}, {"bytesValue": ""}]}}, '["dead","ffef",""]'),
        ({"arrayValue": {"values": [{"stringValue": 'é"\\\n\x01'}, {"intValue": str(2**63 - 1)}]}}, '["é\\"\\\\\\n\\u0001",9223372036854775807]'),
        ({}, "null"),
    ],
)
def test_tree_text(tree, text):
    assert tree_text(tree) == text


@pytest.mark.parametrize(
    "value, text",
    [(1.0, "1.0"), (-0.0, "-0.0"), (0.1, "0.1"), (1e15, "1000000000000000.0"), (1e16, "1e16"), (1.5e300, "1.5e300"),
     (1e-5, "0.00001"), (1.25e-5, "0.0000125"), (1e-6, "1e-6"), (1.25e-7, "1.25e-7"), (5e-324, "5e-324")],
)
def test_double_text(value, text):
    assert double_text(value) == text and float(text) == value


def test_deep_trees_do_not_need_a_deep_stack():
    tree = {"intValue": "7"}
    for _ in range(20_000):
        tree = {"arrayValue": {"values": [tree]}}
    assert tree_text(tree) == "[" * 20_000 + "7" + "]" * 20_000
    text = '{"values":[{"arrayValue":' * 100_000 + "{}" + "}]}" * 100_000
    assert nested_text("arrayValue", text) in (text, "[" * 100_001 + "]" * 100_001)


def test_base64_of_either_alphabet():
    assert bytes_of("+/8=") == bytes_of("-_8") == b"\xfb\xff" and bytes_of("A") == b""


def random_tree(rng, depth):
    """A tree and what it stands for."""
    kind = rng.randrange(7 if depth else 5)
    if kind == 0:
        return {"stringValue": (s := rng.choice(["", "ü", "a\tb"]))}, s
    if kind == 1:
        return {"intValue": str(n := rng.randrange(-9, 9))}, n
    if kind == 2:
        return {"boolValue": (b := rng.random() < 0.5)}, b
    if kind == 3:
        return {"bytesValue": "AQI="}, "0102"
    if kind == 4:
        return {}, None
    inner = [random_tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 5:
        return {"arrayValue": {"values": [t for t, _ in inner]}}, [v for _, v in inner]
    keys = [rng.choice("abc") for _ in inner]
    pairs = [{"key": k, "value": t} for k, (t, _) in zip(keys, inner)]
    return {"kvlistValue": {"values": pairs}}, {k: v for k, (_, v) in zip(keys, inner)}


def test_nested_attributes_and_bodies_arrive_as_compact_json(spark, tmp_path):
    rng = random.Random(4)
    trees = [t for t in (random_tree(rng, 6) for _ in range(600)) if "arrayValue" in t[0] or "kvlistValue" in t[0]]
    records = [{"body": t, "attributes": [{"key": "tree", "value": t}, {"key": "n", "value": {"intValue": i}}]} for i, (t, _) in enumerate(trees)]
    got = {r.attrs["n"]: (r.body, r.attrs["tree"]) for r in rows_of(landed(spark, tmp_path, request(*records)))}
    write = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got == {str(i): (write(v), write(v)) for i, (_, v) in enumerate(trees)} and len(got) > 100


def test_scalars_ids_times_and_severities(spark, tmp_path):
    full = {
        "timeUnixNano": str(NOW), "observedTimeUnixNano": NOW - 1, "severityNumber": "SEVERITY_NUMBER_WARN2",
        "severityText": "w", "traceId": "5B8EFFF798038103D269B633813FC60C", "spanId": "eee19b7ec3c1b174",
        "body": {"doubleValue": 1e21}, "droppedAttributesCount": 3,
        "attributes": [
            {"key": "i", "value": {"intValue": "-12"}}, {"key": "j", "value": {"intValue": 12}},
            {"key": "d", "value": {"doubleValue": "NaN"}}, {"key": "b", "value": {"boolValue": True}},
            {"key": "raw", "value": {"bytesValue": "3q0="}}, {"key": "none"}, {"key": "e", "value": {}},
        ],
    }
    odd = {"timeUnixNano": str(2**64 - 1), "severityNumber": 99, "severityText": "odd", "traceId": "xyz", "spanId": "00" * 8, "body": {"stringValue": ""}}
    lines = [
        request(full, odd, attributes=[{"key": "service.name", "value": {"stringValue": "ledger"}}], request_id="r1", x_api_key="k"),
        "{ not json", json.dumps({"resourceLogs": []}), json.dumps({"resourceLogs": None}), "{}",
        request({}),
    ]
    batches = landed(spark, tmp_path, *lines)
    told = {(r.request_id, r.x_api_key, r.readable) for r in batches.collect()}
    assert ("r1", "k", True) in told and (None, None, False) in told
    rows = {r.body: r for r in rows_of(batches.where("request_id = 'r1'"))}
    row = rows["1" + "0" * 21]
    assert (row.ts, row.severity, row.service) == (NOW, "WARN", "ledger")
    assert (row.trace_id, row.span_id) == ("5b8efff798038103d269b633813fc60c", "eee19b7ec3c1b174")
    assert row.attrs == {"i": "-12", "j": "12", "d": "NaN", "b": "true", "raw": "dead", "none": "", "e": ""}
    assert (rows[""].ts, rows[""].severity, rows[""].trace_id, rows[""].span_id) == (NOW, "ODD", "", "")
    empty = rows_of(batches.where("readable AND request_id IS NULL"))
    assert [(r.body, r.service, r.attrs, r.resource) for r in empty] == [("", "unknown", {}, {})]


def test_stream_reads_what_a_batch_reads(spark, tmp_path):
    tree = {"kvlistValue": {"values": [{"key": "a", "value": {"arrayValue": {"values": [{"intValue": "1"}]}}}]}}
    path = tmp_path / "in"
    path.mkdir()
    for i in range(3):
        (path / f"{i}.json").write_text(request({"severityText": f"s{i}", "body": tree}), encoding="utf-8")
    stream = read_export_batches(spark, str(path), "otlp_json", streaming=True)
    query = (
        explode_records(stream).select("record.severity_text", "record.body.json_value").writeStream.format("memory")
        .queryName("standard_rows").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("standard_rows").collect()} == {(f"s{i}", '{"a":[1]}') for i in range(3)}


def test_only_the_reader_uses_arrow_and_nothing_is_shuffled(spark, tmp_path):
    plan = plan_of(map_resolved(landed(spark, tmp_path, request({})).withColumn("tenant_id", F.lit("a")), NOW))
    assert plan.count("MapInArrow (") >= 1 and "Exchange" not in plan and "ArrowEval" not in plan
