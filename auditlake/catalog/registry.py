"""Registry of named queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlake.plans.sized import spread_small

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL where there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Tables whose rows are costly to work on.
TEXT_TABLES = ["documents", "pages", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; texts are spread over the cores where the file is small."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(rows) if name in TEXT_TABLES else rows
