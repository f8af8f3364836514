"""API keys: lookup of a request's tenant, issue and revocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mapping import key_hash_col, request_key_col


def live_keys(keys: DataFrame) -> DataFrame:
    return keys.filter(F.col("revoked_at").isNull()).select("key_hash", "tenant_id")


def with_key_hash(requests: DataFrame) -> DataFrame:
    """Adds the hash of the request's key; NULL where it sent none."""
    key = request_key_col(F.col("x_api_key"), F.col("authorization"))
    return requests.withColumn("key_hash", key_hash_col(key))


def lookup(requests: DataFrame, keys: DataFrame, how: str, hint: str | None = None) -> DataFrame:
    """Join requests to live keys on `key_hash`; `hint` names a join strategy to prefer.

    Spark broadcasts the keys below its threshold; else both sides are shuffled and
    adaptive execution splits a sender with a large share of the requests. Requests
    without key match nothing; numbers stand for their keys in the join, so that they
    spread over all tasks.
    """
    none = F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string"))
    known = live_keys(keys).withColumnRenamed("key_hash", "_key")
    if hint:
        known = known.hint(hint)
    keyed = requests.withColumn("_key", F.coalesce("key_hash", none))
    return keyed.join(known, "_key", how).drop("_key")


def asked_keys(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """The rows of the key table that some request asks for.

    What a join broadcasts then follows the requests of a micro-batch, not the key table.
    Only hashes of keys are shuffled.
    """
    asked = with_key_hash(requests).select("key_hash").where("key_hash IS NOT NULL").distinct()
    return keys.join(asked.hint("merge"), "key_hash", "left_semi")


def resolve_tenant(requests: DataFrame, keys: DataFrame, hint: str | None = None) -> DataFrame:
    """Requests of a known, unrevoked key, with their `tenant_id`."""
    return lookup(with_key_hash(requests), keys, "inner", hint)


def unknown_keys(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests whose key is missing, unknown or revoked."""
    return lookup(with_key_hash(requests), keys, "left_anti")


def seed_keys(keys: DataFrame, new: DataFrame) -> DataFrame:
    """Key table with `new` added; a hash that exists already stays as it is.

    Of several new rows with one hash the earliest created is taken.
    """
    rest = [name for name in keys.columns if name != "key_hash"]
    ordered = F.struct("created_at", *[name for name in rest if name != "created_at"])
    fresh = (
        new.groupBy("key_hash")
        .agg(F.min(ordered).alias("_row"))
        .join(keys.select("key_hash"), "key_hash", "left_anti")
        .select("key_hash", "_row.*")
        .select(*keys.columns)
    )
    return keys.unionByName(fresh)


def revoke_keys(keys: DataFrame, hashes: DataFrame, now: Column) -> DataFrame:
    """Key table with `revoked_at` set for the given hashes.

    A key that was revoked before gets the new time too.
    """
    marked = hashes.select("key_hash").distinct().withColumn("_hit", F.lit(True))
    return (
        keys.join(marked, "key_hash", "left")
        .withColumn("revoked_at", F.when(F.col("_hit"), now).otherwise(F.col("revoked_at")))
        .select(*keys.columns)
    )
