"""Name -> (Spark query, oracle SQL) of the telemetry operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame, with its SQL where there is one."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = oracle
        return f

    return add
