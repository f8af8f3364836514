"""The API key table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import API_KEYS


def read_api_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(API_KEYS).parquet(path)


def write_api_keys(keys: DataFrame, path: str) -> None:
    """Write to a new path: Spark cannot overwrite a table it is reading."""
    keys.select(*API_KEYS.names).write.mode("error").parquet(path)
