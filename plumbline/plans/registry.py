"""The named queries: a function of (spark, folder of tables) and the SQL that gives the same rows, if SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Query]:
    from . import catalog, code_catalog  # noqa: F401  (they register theirs)

    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from . import catalog, code_catalog  # noqa: F401

    return {k: s for k, (_, s) in REGISTRY.items() if s}
