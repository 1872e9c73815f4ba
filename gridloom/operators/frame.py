"""Columns of a frame: choosing, adding, renaming, casting, encoding, and a profile of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _known(df: DataFrame, *names: str) -> None:
    for n in names:
        if n not in df.columns:
            raise KeyError(f"no column {n}")


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    _known(df, *names)
    return df.select(*names)


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, value)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    _known(df, name)
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    _known(df, old)
    if new in df.columns:
        raise ValueError(f"column {new} exists")
    return df.withColumnRenamed(old, new)


def to_integer(c: Column) -> Column:
    """A number cut off towards zero, and held at the ends of the long range instead of overflowing."""
    big = 9223372036854775807
    return F.when(c >= float(big), F.lit(big)).when(c <= -float(big), F.lit(-big - 1)).otherwise(F.when(F.isnan(c.cast("double")), F.lit(0)).otherwise(c.try_cast("long")))


def one_hot_encode(df: DataFrame, column: str, values: list | None = None, most: int = 1000) -> DataFrame:
    """A Boolean column for each value; null has false in all. Unless given, the values are those of the column, sorted;
    more than `most` are refused."""
    _known(df, column)
    if values is None:
        found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{column} has more than {most} values")
        values = sorted(r[0] for r in found)
    return df.select(*(c for c in df.columns if c != column), *(F.coalesce(F.col(column) == v, F.lit(False)).alias(f"{column}_{v}") for v in values))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """column_code: the place of each label among the sorted distinct labels, from 0, ranked by ranges."""
    from gridloom.operators import running

    labels = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(running.numbered(labels, [column], f"{column}_code"), column, "left")


def profile(df: DataFrame) -> DataFrame:
    """A row for each numeric column: count, nulls, distinct values, least, greatest, mean, deviation and adjusted skewness."""
    from gridloom.functions.statistics import skewness

    names = numeric(df)
    stats = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("count"), F.sum(F.col(c).isNull().cast("long")).alias("null_count"), F.count_distinct(c).alias("unique_count"),
        F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), skewness(c).alias("skew"),
    )
    return df.agg(F.array(*map(stats, names)).alias("s")).select(F.inline("s"))


def transpose(df: DataFrame, index: str) -> DataFrame:
    """Columns become rows, named by the values of `index`; for small frames."""
    return df.transpose(F.col(index))


def dot(df: DataFrame, keys: list[str], columns: list[str], matrix: list[list[float]]) -> DataFrame:
    """The rows' product with a small matrix: columns col_0 and so on."""
    if len(matrix) != len(columns):
        raise ValueError("the matrix needs a row for each column")
    return df.select(*keys, *(sum((F.col(c) * float(row[j]) for c, row in zip(columns, matrix, strict=True)), F.lit(0.0)).alias(f"col_{j}") for j in range(len(matrix[0]))))
