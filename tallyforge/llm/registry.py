"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.sources.files import load_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Register a query on one whole table."""

    def register(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(load_table(spark, folder, table))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
