"""Functions of the user's own: on columns, on groups, and from rows to tables, all in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register_function(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str):
    """f of whole columns (pandas Series) as a function for SQL and DataFrames; it is returned too."""

    def of(*columns: pd.Series) -> pd.Series:
        return f(*columns)

    def one(a: pd.Series) -> pd.Series:
        return f(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return f(a, b)

    n = f.__code__.co_argcount
    return spark.udf.register(name, F.pandas_udf({1: one, 2: two}.get(n, of), returns))


def register_aggregate(spark: SparkSession, name: str, f: Callable[[pd.Series], object], returns: str):
    """f of a group's column as an aggregate. A group is held whole by one task: for groups of bounded size."""

    def of(a: pd.Series) -> float:
        return f(a)

    of.__annotations__["return"] = {"double": float, "long": int, "int": int, "string": str}[returns]
    return spark.udf.register(name, F.pandas_udf(of, returns))


def register_table(spark: SparkSession, name: str, f: Callable[..., Iterator[tuple]], returns: str):
    """f of scalars as a table function: each call gives rows."""

    class Rows:
        def eval(self, *values):
            yield from f(*values)

    return spark.udtf.register(name, F.udtf(Rows, returnType=returns))


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], returns: str) -> DataFrame:
    """f of each Arrow batch of rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(f, batches)

    return df.mapInArrow(of, returns)


def fold_groups(df: DataFrame, keys: list[str], start: str, step: str, value: str, order: list[str], name: str = "out") -> DataFrame:
    """(keys, name): a state carried along each group's values in their order, by SQL expressions: `start`, and `step` of s
    (the state so far) and x (a value). A group's values are held as one array: for groups of bounded size."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__x")))).alias("__v"))
    return rows.select(*keys, F.expr(f"aggregate(transform(__v, r -> r.__x), {start}, (s, x) -> {step})").alias(name))
