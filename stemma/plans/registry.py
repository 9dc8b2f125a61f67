"""All queries over the driver tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (t) -> DataFrame, where t(table) reads a driver table."""

    def register(work):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def t(table: str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{table}.parquet")

            t.spark = spark
            t.path = lambda table: f"{sf_dir}/{table}.parquet"
            return work(t)

        run.__doc__ = work.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return work

    return register
