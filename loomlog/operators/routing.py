"""What becomes of each ingest request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mapping import header_text
from .tenants import lookup, with_key_hash

# Largest request body in bytes, largest number of records per request.
MAX_BODY_BYTES = 16_777_216
MAX_ROWS = 1_000_000

CONTENT_TYPE = "application/x-protobuf"


def route_requests(
    requests: DataFrame,
    keys: DataFrame,
    max_body: int = MAX_BODY_BYTES,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Adds `tenant_id`, `status` and `outcome`; the first failing check decides.

    A request without content type passes that check, and an empty request is
    accepted. Expects `request_id, content_type, x_api_key, authorization,
    body_bytes, readable, record_count`.
    """
    found = lookup(with_key_hash(requests), keys, "left")
    content_type = header_text(F.col("content_type"))
    checks = (
        (~content_type.startswith(CONTENT_TYPE), 415, "unsupported_content_type"),
        (F.col("key_hash").isNull(), 401, "missing_key"),
        (F.col("tenant_id").isNull(), 401, "invalid_key"),
        (F.col("body_bytes") > max_body, 413, "body_too_large"),
        (~F.col("readable"), 400, "unreadable_body"),
        (F.col("record_count") > max_rows, 413, "too_many_records"),
    )
    status, outcome = F, F
    for failed, code, name in checks:
        status = status.when(failed, code)
        outcome = outcome.when(failed, name)
    return found.select(
        *requests.columns,
        "tenant_id",
        status.otherwise(200).alias("status"),
        outcome.otherwise("accepted").alias("outcome"),
    )


def accepted(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("status") == 200)


def dead_letters(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("status") != 200)
