from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loomlog.functions.mapping import key_hash_col, request_key_col
from loomlog.operators import tenants
from loomlog.operators.routing import route_requests

WHEN = dt.datetime(2024, 1, 1)


def key_table(spark, rows):
    frame = spark.createDataFrame(
        rows, "id string, k string, tenant_id string, created_at timestamp, revoked_at timestamp"
    )
    return frame.select(
        "id", key_hash_col(F.col("k")).alias("key_hash"), "tenant_id", "created_at", "revoked_at"
    )


def keys(spark):
    return key_table(spark, [
        ("1", "key-of-ann", "north", WHEN, None),
        ("2", "key-of-bo", "south", WHEN, None),
        ("3", "key-gone", "north", WHEN, WHEN),
    ])


HEADERS = [
    ("q1", "key-of-ann", None, "key-of-ann"),
    ("q2", None, "Bearer key-of-bo", "key-of-bo"),
    ("q3", "key-of-bo", "Bearer key-of-ann", "key-of-bo"),
    ("q4", "", "Bearer key-of-ann", ""),
    ("q5", None, "bearer key-of-ann", None),
    ("q6", None, "Bearer ", ""),
    ("q7", None, None, None),
    ("q8", "clé", "Bearer key-of-ann", "key-of-ann"),
    ("q9", "key-gone", None, "key-gone"),
    ("q10", "NEVER", None, "NEVER"),
]


def requests(spark):
    return spark.createDataFrame(
        [h[:3] for h in HEADERS], "request_id string, x_api_key string, authorization string"
    )


def test_request_key(spark):
    key = request_key_col(F.col("x_api_key"), F.col("authorization"))
    got = {r.request_id: r.k for r in requests(spark).select("request_id", key.alias("k")).collect()}
    assert got == {h[0]: h[3] for h in HEADERS}


def test_lookup_by_broadcast_and_by_shuffle(spark):
    known = {("q1", "north"), ("q2", "south"), ("q3", "south"), ("q8", "north")}
    for limit in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        found = tenants.resolve_tenant(requests(spark), keys(spark))
        assert {(r.request_id, r.tenant_id) for r in found.collect()} == known
        refused = tenants.unknown_keys(requests(spark), keys(spark))
        assert {r.request_id for r in refused.collect()} == (
            {h[0] for h in HEADERS} - {q for q, _ in known}
        )
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_seed_and_revoke(spark):
    later = WHEN + dt.timedelta(days=1)
    new = key_table(spark, [
        ("9", "key-of-ann", "stolen", WHEN, None),
        ("8", "FRESH", "second", later, None),
        ("7", "FRESH", "first", WHEN, None),
    ])
    seeded = tenants.seed_keys(keys(spark), new)
    assert seeded.columns == keys(spark).columns
    assert sorted((r.id, r.tenant_id) for r in seeded.collect()) == [
        ("1", "north"), ("2", "south"), ("3", "north"), ("7", "first")
    ]
    gone = seeded.filter("id = '1'").select("key_hash")
    revoked = tenants.revoke_keys(seeded, gone.unionByName(gone), F.lit(later))
    assert {r.id: r.revoked_at for r in revoked.collect()} == {
        "1": later, "2": None, "3": WHEN, "7": None
    }


def test_first_failing_check_decides(spark):
    good = {"content_type": "application/x-protobuf", "x_api_key": "key-of-ann",
            "authorization": None, "body_bytes": 10, "readable": True, "record_count": 5}
    cases = [
        ({}, 200, "accepted"),
        ({"content_type": None, "record_count": 0}, 200, "accepted"),
        ({"content_type": "application/x-protobuf;v=1"}, 200, "accepted"),
        ({"content_type": "text/plain", "x_api_key": None}, 415, "unsupported_content_type"),
        ({"x_api_key": None, "body_bytes": 2**30}, 401, "missing_key"),
        ({"x_api_key": "key-gone"}, 401, "invalid_key"),
        ({"x_api_key": "NEVER", "readable": False}, 401, "invalid_key"),
        ({"body_bytes": 16_777_217, "readable": False}, 413, "body_too_large"),
        ({"body_bytes": 16_777_216, "readable": False}, 400, "unreadable_body"),
        ({"record_count": 1_000_001}, 413, "too_many_records"),
        ({"record_count": 1_000_000}, 200, "accepted"),
    ]
    rows = [(str(i), *{**good, **case[0]}.values()) for i, case in enumerate(cases)]
    frame = spark.createDataFrame(
        rows, "request_id string, content_type string, x_api_key string, authorization string,"
        " body_bytes bigint, readable boolean, record_count bigint"
    )
    routed = route_requests(frame, keys(spark)).collect()
    assert {int(r.request_id): (r.status, r.outcome) for r in routed} == {
        i: case[1:] for i, case in enumerate(cases)
    }
