"""Whole-column and grouped aggregates, with exact quantiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import running
from gridloom.operators.frame import numeric


def clean(c: str | Column) -> Column:
    """A number, with NaN as null: least and greatest pass over NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c.cast("double")), c)


def first_of(c: str, order: str) -> Column:
    """The first non-null value by another column, the same in every run."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))


def last_of(c: str, order: str) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))


AGGREGATES = {
    "sum": lambda c: F.sum(c).cast("double"),
    "mean": F.avg,
    "count": F.count,
    "min": lambda c: F.min(clean(c)).cast("double"),
    "max": lambda c: F.max(clean(c)).cast("double"),
    "median": F.median,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.count_distinct,
}


def group_by(df: DataFrame, keys: list[str], op: str, columns: list[str] | None = None, order: str | None = None, ascending: bool = True) -> DataFrame:
    """op of every numeric column (or those named) in each group, as {column}_{op}; rows with a null key go; sorted by key."""
    columns = columns or [c for c in numeric(df) if c not in keys]
    if op == "median":
        found = running.quantiles(df, columns, [0.5], keys).groupBy(*keys)
        made = found.agg(*(F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"{c}_median") for c in columns))
        return df.select(*keys).na.drop().distinct().join(made, keys, "left").orderBy(*keys, ascending=ascending)
    if op in ("first", "last"):
        if order is None:
            raise ValueError("first and last need an order column")
        f = lambda c: (first_of if op == "first" else last_of)(c, order)
    else:
        f = AGGREGATES[op]
    some = df.na.drop(subset=keys).groupBy(*keys).agg(*(f(c).alias(f"{c}_{op}") for c in columns))
    return some.orderBy(*keys, ascending=ascending)


def transform(df: DataFrame, keys: list[str], op: str, columns: list[str]) -> DataFrame:
    """The group's value beside each row; null for rows with a null key. One row a group is made first and joined back, so
    that a large group stays where it lies."""
    return df.join(group_by(df, keys, op, columns), keys, "left").select(*df.columns, *(f"{c}_{op}" for c in columns))


def pivot_table(df: DataFrame, values: str, index: str, columns: str, op: str, known: list | None = None) -> DataFrame:
    """A column {columns}={value} for each value; rows with a null in any of the three go; a missing cell is null."""
    some = df.select(F.col(index).cast("string").alias(index), columns, values).na.drop()
    out = some.groupBy(index).pivot(columns, known).agg(AGGREGATES[op](values))
    return out.select(index, *(F.col(f"`{c}`").alias(f"{columns}={c}") for c in out.columns if c != index))


def resample(df: DataFrame, date: str, bucket_days: int, columns: list[str]) -> DataFrame:
    """Sums by runs of days since 1970-01-01."""
    day = F.unix_date(F.col(date).cast("date"))
    return df.groupBy(F.floor(day / bucket_days).cast("long").alias("bucket")).agg(*(F.sum(c).cast("double").alias(c) for c in columns)).orderBy("bucket")


def describe(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """A row for each statistic, a column for each column: one pass of aggregates, and the ranked value counts."""
    plain = [("count", lambda c: F.count(c).cast("double")), ("mean", F.avg), ("std", F.stddev_samp), ("min", lambda c: F.min(clean(c)).cast("double")), ("max", lambda c: F.max(clean(c)).cast("double"))]
    row = df.agg(*(f(c).alias(f"__{name}_{c}") for name, f in plain for c in columns)).join(F.broadcast(running.quantile_row(df, columns, list(quantiles))))
    made = [F.struct(F.lit(name).alias("statistic"), *(F.col(f"__{name}_{c}").alias(c) for c in columns)) for name, _ in plain[:-1]]
    made += [F.struct(F.lit(f"{q * 100:g}%").alias("statistic"), *(F.col(c)[i].alias(c) for c in columns)) for i, q in enumerate(quantiles)]
    made += [F.struct(F.lit("max").alias("statistic"), *(F.col(f"__max_{c}").alias(c) for c in columns))]
    return row.select(F.inline(F.array(*made)))


def _pairs(df: DataFrame, columns: list[str], f, name: str) -> DataFrame:
    made = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.nanvl(f(a, b), F.lit(None)), F.lit(0.0)).alias(name)) for a, b in combinations(columns, 2)]
    return df.agg(F.array(*made).alias("s")).select(F.inline("s"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of each pair over the rows where both are known; 0 where it isn't defined."""
    return _pairs(df, columns, F.corr, "corr")


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    return _pairs(df, columns, F.covar_samp, "cov")


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def mode(df: DataFrame, column: str) -> DataFrame:
    """The commonest value and its count; ties go to the smaller value."""
    return value_counts(df, column).limit(1)


#: How many bins a rule asks for, from the count, the ends, the deviation and the quartiles.
BIN_RULES = {
    "sturges": lambda n, wide, std, iqr: 1 + F.ceil(F.log2(n)),
    "sqrt": lambda n, wide, std, iqr: F.ceil(F.sqrt(n)),
    "scott": lambda n, wide, std, iqr: F.ceil(F.try_divide(wide * F.cbrt(n), 3.49 * std)),
    "freedman_diaconis": lambda n, wide, std, iqr: F.ceil(F.try_divide(wide * F.cbrt(n), 2 * iqr)),
}


def bin_counts(df: DataFrame, column: str) -> DataFrame:
    """(rule, bins): how many bins each rule asks for, 1 at least."""
    s = df.agg(F.count(column).cast("double").alias("n"), (F.max(column) - F.min(column)).cast("double").alias("wide"), F.stddev_samp(column).alias("std"))
    s = s.join(F.broadcast(running.quantile_row(df, [column], [0.25, 0.75]).select((F.col(column)[1] - F.col(column)[0]).alias("iqr"))))
    made = F.array(*(F.struct(F.lit(k).alias("rule"), F.greatest(F.lit(1), F.coalesce(f(*map(F.col, ("n", "wide", "std", "iqr"))), F.lit(1))).cast("int").alias("bins")) for k, f in BIN_RULES.items()))
    return s.select(F.inline(made))


def histogram(df: DataFrame, column: str, bins: int | str) -> DataFrame:
    """(bin, count) over equal widths between the ends; the greatest value is in the last bin. bins: a number or a rule."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    n = F.lit(bins) if isinstance(bins, int) else F.col("bins")
    if not isinstance(bins, int):
        ends = ends.join(F.broadcast(bin_counts(df, column).where(F.col("rule") == bins)))
    width = (F.col("hi") - F.col("lo")) / n
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / width), n - 1))
    return df.where(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def box(df: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """(q1, median, q3, low, high, outliers): the quartiles, the ends of the whiskers (the outermost values within `reach`
    interquartile ranges), and how many values lie beyond."""
    q = running.quantile_row(df, [column], [0.25, 0.5, 0.75]).select(*(F.col(column)[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))))
    some = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("__v")).join(F.broadcast(q))
    inside = F.col("__v").between(F.col("q1") - reach * (F.col("q3") - F.col("q1")), F.col("q3") + reach * (F.col("q3") - F.col("q1")))
    return some.groupBy("q1", "median", "q3").agg(F.min(F.when(inside, F.col("__v"))).alias("low"), F.max(F.when(inside, F.col("__v"))).alias("high"), F.count_if(~inside).alias("outliers"))
