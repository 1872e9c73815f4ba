"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(t) under a name, where t(table) reads a table; sql is the same in DuckDB's SQL."""

    def register(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return register


from gridloom.plans import aggregation, boosting, clusters, columns, extras, files, further, joins, kernels, matrices, mixtures, models, more, rows, sampling, statistics, whole, windows  # noqa: E402, F401
