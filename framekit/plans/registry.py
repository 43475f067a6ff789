"""Named queries: each has a Spark callable and, where SQL can say it, the equal DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framekit.plans.fixtures import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(slug: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if slug in QUERIES:
            raise ValueError(f"query {slug} is registered twice")
        QUERIES[slug] = fn
        if sql is not None:
            ORACLES[slug] = oracle(sql)
        return fn

    return register
