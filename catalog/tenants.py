"""API keys, request routing and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.operators import tenants
from loomlog.operators.aggregates import reconcile
from loomlog.operators.routing import accepted, dead_letters, route_requests
from loomlog.session import scratch_path
from loomlog.sources.keys import read_api_keys, write_api_keys

from .fixtures import (
    KEYS_SQL,
    LOGS_SQL,
    MAX_TEST_ROWS,
    REQUESTS_SQL,
    api_keys,
    flat_keys,
    logs,
    requests,
)
from .registry import register


@register(
    "read_api_keys", "SELECT id, key_hash, tenant_id, created_s, revoked_s FROM api_keys",
    (KEYS_SQL,),
)
def read_keys(spark, sf_dir):
    path = scratch_path(spark, "api-keys")
    write_api_keys(api_keys(spark, sf_dir), path)
    return flat_keys(read_api_keys(spark, path))


@register(
    "seed_api_keys",
    """SELECT id, key_hash, tenant_id, created_s, revoked_s FROM api_keys
    UNION ALL SELECT md5('new' || c_custkey), sha256('fresh-' || c_custkey),
      'tenant-' || (c_custkey % 5), CAST(1710000000 + c_custkey AS BIGINT), NULL
    FROM api_keys WHERE c_custkey % 4 = 0""",
    (KEYS_SQL,),
)
def seed_keys(spark, sf_dir):
    """Every fourth customer gets a new key; the others ask for one they hold.

    Each request comes twice, the later copy with another tenant.
    """
    keys = api_keys(spark, sf_dir)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn(
        "copy", F.explode(F.array(F.lit(0), F.lit(1)))
    )
    new = customers.selectExpr(
        "md5(concat('new', c_custkey)) as id",
        "sha2(concat(case when c_custkey % 4 = 0 then 'fresh-' else 'key-' end, c_custkey), 256)"
        " as key_hash",
        "concat('tenant-', c_custkey % 5 + copy) as tenant_id",
        "timestamp_seconds(1710000000 + c_custkey + copy) as created_at",
        "cast(null as timestamp) as revoked_at",
    )
    return flat_keys(tenants.seed_keys(keys, new))


@register(
    "revoke_api_keys",
    """SELECT id, key_hash, tenant_id, created_s,
      CASE WHEN c_custkey % 5 = 0 THEN 1720000000 ELSE revoked_s END AS revoked_s FROM api_keys""",
    (KEYS_SQL,),
)
def revoke_keys(spark, sf_dir):
    hashes = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "sha2(concat('key-', c_custkey - c_custkey % 5), 256) as key_hash"
    )
    when = F.timestamp_seconds(F.lit(1720000000))
    return flat_keys(tenants.revoke_keys(api_keys(spark, sf_dir), hashes, when))


@register(
    "resolve_tenant",
    """SELECT r.request_id, k.tenant_id FROM requests r
    JOIN api_keys k ON sha256(r.api_key) = k.key_hash AND k.revoked_s IS NULL""",
    (REQUESTS_SQL,),
)
def resolve_tenant(spark, sf_dir):
    found = tenants.resolve_tenant(requests(spark, sf_dir), api_keys(spark, sf_dir))
    return found.select("request_id", "tenant_id")


@register(
    "resolve_tenant_salted",
    """SELECT r.request_id, k.tenant_id FROM requests r
    JOIN api_keys k ON sha256(r.api_key) = k.key_hash AND k.revoked_s IS NULL""",
    (REQUESTS_SQL,),
)
def resolve_tenant_salted(spark, sf_dir):
    """The way taken when the key table is too large to broadcast."""
    found = tenants.resolve_tenant(requests(spark, sf_dir), api_keys(spark, sf_dir), "merge")
    return found.select("request_id", "tenant_id")


@register(
    "reject_unknown_keys",
    """SELECT request_id, arrived_ns FROM requests r WHERE NOT EXISTS (
      SELECT 1 FROM api_keys k WHERE sha256(r.api_key) = k.key_hash AND k.revoked_s IS NULL)""",
    (REQUESTS_SQL,),
)
def reject_unknown_keys(spark, sf_dir):
    refused = tenants.unknown_keys(requests(spark, sf_dir), api_keys(spark, sf_dir))
    return refused.select("request_id", "arrived_ns")


def routed(spark, sf_dir):
    return route_requests(
        requests(spark, sf_dir), api_keys(spark, sf_dir), max_rows=MAX_TEST_ROWS
    )


@register(
    "route_requests",
    """SELECT request_id, outcome, CASE WHEN outcome IN ('accepted', 'body_too_large',
        'unreadable_body', 'too_many_records') THEN tenant_id END AS tenant_id,
      CASE outcome WHEN 'unsupported_content_type' THEN 415 WHEN 'missing_key' THEN 401
        WHEN 'invalid_key' THEN 401 WHEN 'body_too_large' THEN 413 WHEN 'unreadable_body' THEN 400
        WHEN 'too_many_records' THEN 413 ELSE 200 END AS status FROM routed""",
    (REQUESTS_SQL,),
)
def route(spark, sf_dir):
    rows = routed(spark, sf_dir)
    parts = accepted(rows).unionByName(dead_letters(rows))
    known = F.when(~F.col("status").isin(401, 415), F.col("tenant_id")).alias("tenant_id")
    return parts.select("request_id", "outcome", known, "status")


@register(
    "reconcile_counts",
    """, took AS (SELECT tenant_id, sum(record_count) AS accepted FROM routed
      WHERE outcome = 'accepted' GROUP BY tenant_id),
    kept AS (SELECT tenant_id, count(*) AS stored FROM logs
      WHERE tenant_id <> 'tenant-2' GROUP BY tenant_id)
    SELECT tenant_id, CAST(coalesce(accepted, 0) AS BIGINT) AS accepted,
      coalesce(stored, 0) AS stored,
      CAST(coalesce(accepted, 0) AS BIGINT) - coalesce(stored, 0) AS difference
    FROM took FULL JOIN kept USING (tenant_id)""",
    (REQUESTS_SQL, LOGS_SQL),
)
def reconcile_counts(spark, sf_dir):
    """Stored rows lack one tenant, so a one-sided group shows too."""
    taken = accepted(routed(spark, sf_dir)).select("tenant_id", F.col("record_count").alias("rows"))
    return reconcile(taken, logs(spark, sf_dir).filter("tenant_id <> 'tenant-2'"), "tenant_id")


@register(
    "reconcile_counts_whole",
    """, took AS (SELECT tenant_id, sum(record_count) AS accepted FROM routed
      WHERE outcome = 'accepted' GROUP BY tenant_id),
    kept AS (SELECT tenant_id, count(*) AS stored FROM logs GROUP BY tenant_id)
    SELECT tenant_id, CAST(coalesce(accepted, 0) AS BIGINT) AS accepted,
      coalesce(stored, 0) AS stored,
      CAST(coalesce(accepted, 0) AS BIGINT) - coalesce(stored, 0) AS difference
    FROM took FULL JOIN kept USING (tenant_id)""",
    (REQUESTS_SQL, LOGS_SQL),
)
def reconcile_counts_whole(spark, sf_dir):
    taken = accepted(routed(spark, sf_dir)).select("tenant_id", F.col("record_count").alias("rows"))
    return reconcile(taken, logs(spark, sf_dir), "tenant_id")
