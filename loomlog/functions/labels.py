"""Labels a search can match on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels stored as columns of their own.
COLUMN_LABELS = ("service", "severity", "trace_id", "span_id")


def label_col(name: str) -> Column:
    """Value of a label: a real column, else attribute, else resource, else ''.

    An attribute that is present but empty wins over the resource.
    """
    if name in COLUMN_LABELS:
        return F.col(name)
    return F.coalesce(F.col("attrs")[name], F.col("resource")[name], F.lit(""))
