"""Named queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stagecraft.llm.util import tune_batches
from stagecraft.runtime import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` under a name."""
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(tune_batches(tune(spark)), folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
