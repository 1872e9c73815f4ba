"""Ordered columns: running, rolling and ranked values. Every one takes its order, and the partition if any.

The order should be unique; null values give null and don't stop what runs on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from gridloom.operators import running


def ordered(partition: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order)


def _so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _where_known(c: str, out: Column) -> Column:
    return F.when(F.col(c).isNotNull(), out)


def cumsum(c: str, w: WindowSpec) -> Column:
    return _where_known(c, F.sum(c).over(_so_far(w)))


def cumprod(c: str, w: WindowSpec) -> Column:
    return _where_known(c, F.product(c).over(_so_far(w)))


def diff(c: str, w: WindowSpec) -> Column:
    return F.col(c) - F.lag(c).over(w)


def pct_change(c: str, w: WindowSpec) -> Column:
    before = F.lag(c).over(w)
    return F.try_divide(F.col(c) - before, before)


def shift(c: str, n: int, w: WindowSpec) -> Column:
    return F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w)


ROLLING = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def rolling(op: str, c: str, width: int, w: WindowSpec) -> Column:
    """Null until `width` rows are there, or if one of them is null."""
    frame = w.rowsBetween(1 - width, 0)
    return F.when(F.count(c).over(frame) == width, ROLLING[op](c).over(frame))


EXPANDING = {"mean": F.avg, "sum": F.sum, "var": F.var_samp}


def expanding(op: str, c: str, w: WindowSpec) -> Column:
    return _where_known(c, EXPANDING[op](c).over(_so_far(w)))


def moving_average(c: str, width: int, w: WindowSpec) -> Column:
    """With shorter frames at the start."""
    return F.avg(c).over(w.rowsBetween(1 - width, 0))


def median_filter(c: str, width: int, w: WindowSpec) -> Column:
    return F.percentile(c, F.lit(0.5)).over(w.rowsBetween(1 - width, 0))


def rank(c: str, partition: list[str], method: str = "average") -> Column:
    w, peers = Window.partitionBy(*partition, F.col(c).isNull()).orderBy(c), Window.partitionBy(*partition, c)
    low = F.rank().over(w)
    made = {"dense": F.dense_rank().over(w), "min": low, "max": low + F.count("*").over(peers) - 1, "average": low + (F.count("*").over(peers) - 1) / 2}
    return _where_known(c, made[method].cast("double"))


def _beside(df: DataFrame, keys: list[str], made: dict[str, Column]) -> DataFrame:
    """df with one row of aggregates a group joined to its rows, so that a large group stays where it lies."""
    if not keys:
        return df.join(F.broadcast(df.agg(*(v.alias(k) for k, v in made.items()))))
    ends = df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(*(v.alias(k) for k, v in made.items()))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(ends, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def zscore(df: DataFrame, c: str, out: str, keys: list[str] = ()) -> DataFrame:
    """(x - mean) / sample deviation of the group, 0 without any."""
    some = _beside(df, list(keys), {"__m": F.avg(c), "__s": F.stddev_samp(c)})
    return some.withColumn(out, F.when(F.col("__s") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def normalize(df: DataFrame, c: str, out: str, keys: list[str] = (), method: str = "minmax") -> DataFrame:
    """Between 0 and 1 by the group's ends, or by its greatest absolute value (maxabs)."""
    some = _beside(df, list(keys), {"__a": F.min(c).cast("double"), "__b": F.max(c).cast("double"), "__t": F.max(F.abs(c)).cast("double")})
    low, high, top = F.col("__a"), F.col("__b"), F.col("__t")
    made = F.when(top == 0, F.lit(0.0)).otherwise(F.col(c) / top) if method == "maxabs" else F.when(high == low, F.lit(0.0)).otherwise((F.col(c) - low) / (high - low))
    return some.withColumn(out, made).drop("__a", "__b", "__t")


def clip(c: str, low: float, high: float) -> Column:
    return _where_known(c, F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high)))


def cut(df: DataFrame, c: str, bins: int, out: str) -> DataFrame:
    """Bins of equal width from 0; the ends come from one small aggregate."""
    ends = df.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(c) - F.col("__lo")) / width), F.lit(bins - 1)))
    return df.join(F.broadcast(ends)).withColumn(out, _where_known(c, at.cast("int"))).drop("__lo", "__hi")


def qcut(c: str, q: int, partition: list[str], order: list[str]) -> Column:
    """floor(rank * q / n), with ranks from 0 and ties by the order."""
    w = Window.partitionBy(*partition, F.col(c).isNull())
    at = F.floor((F.row_number().over(w.orderBy(c, *order)) - 1) * q / F.count("*").over(w))
    return _where_known(c, at.cast("int"))


def forward_fill(c: str, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(_so_far(w))


def backward_fill(c: str, w: WindowSpec) -> Column:
    return F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def _interpolated(c: str, w: WindowSpec) -> Column:
    before, after = _so_far(w), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(c).isNotNull(), F.col("__at"))
    v0, v1 = F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(after)
    p0, p1 = F.last(known, ignorenulls=True).over(before), F.first(known, ignorenulls=True).over(after)
    return F.coalesce(F.col(c).cast("double"), v0 + (v1 - v0) * (F.col("__at") - p0) / F.nullif(p1 - p0, F.lit(0)), v0, v1)


def interpolate(df: DataFrame, c: str, out: str, partition: list[str], order: list[str], method: str = "linear") -> DataFrame:
    """Linear by the number of rows, beyond the known values the nearest; or the last known value before (forward), or the
    next one after (backward)."""
    w = ordered(partition, order)
    if method != "linear":
        return df.withColumn(out, {"forward": forward_fill, "backward": backward_fill}[method](c, w).cast("double"))
    return df.withColumn("__at", F.row_number().over(w)).withColumn(out, _interpolated(c, w)).drop("__at")


def drawdown(c: str, w: WindowSpec) -> Column:
    """How far a value lies below the highest so far, in per cent."""
    peak = F.max(c).over(_so_far(w))
    return F.try_divide(peak - F.col(c), peak) * 100


def is_peak(c: str, w: WindowSpec) -> Column:
    return F.coalesce((F.col(c) > F.lag(c).over(w)) & (F.col(c) > F.lead(c).over(w)), F.lit(False))


def outlier_iqr(df: DataFrame, c: str, k: float, out: str, between: bool = True) -> DataFrame:
    """Whether a value lies over k interquartile ranges beyond the quartiles: between values where they fall between two, or else the
    values at n / 4 and 3 n / 4, rounded down, of the sorted ones (from 0)."""
    if between:
        ends = running.quantile_row(df, [c], [0.25, 0.75]).select(F.col(c)[0].alias("__a"), F.col(c)[1].alias("__b"))
    else:
        counted = running.totals_before(df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")), c, ["n"])
        placed = running.checkpointed(counted)
        n = placed.agg(F.sum("n")).first()[0] or 0
        at = lambda p: F.max(F.when(F.col("before_n") <= p, F.col(c)))
        ends = placed.agg(at(n // 4).alias("__a"), at(min(3 * n // 4, max(n - 1, 0))).alias("__b"))
    far = (F.col(c) < F.col("__a") - k * (F.col("__b") - F.col("__a"))) | (F.col(c) > F.col("__b") + k * (F.col("__b") - F.col("__a")))
    return df.join(F.broadcast(ends)).withColumn(out, F.coalesce(far, F.lit(False))).drop("__a", "__b")
