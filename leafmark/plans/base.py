"""Where queries and the SQL that they are held against are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmark.sources.views import views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function by its name, with SQL that may name domain views; None where SQL can't express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def domain(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Domain views that share what they are made from."""
    return views(spark, sf_dir, *(f"v_{n}" for n in names))
