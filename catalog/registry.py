"""Registration of checked queries: a Spark callable and, where possible, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, ctes: tuple[str, ...] = ()):
    """Register the decorated function under `name`; `ctes` go before the oracle."""
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = ("WITH " + ",".join(ctes) + "\n" if ctes else "") + oracle.strip()
        return function

    return add
