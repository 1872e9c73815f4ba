"""Running totals over a whole column, and what follows from them, without one task that sees all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine a temporary one, if that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def totals_before(df: DataFrame, order: str | list[str], columns: list[str]) -> DataFrame:
    """df with before_{column}: the sum over the rows that come before by a unique order of one or more columns.

    Rows are dealt by ranges of the order; each range is summed by itself, and the ranges' totals, one row each, are
    added up and broadcast.
    """
    order = [order] if isinstance(order, str) else order
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    ranges = dealt.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = ranges.select("__range", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in columns))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made = {f"before_{c}": F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}
    return dealt.join(F.broadcast(bases), "__range").withColumns(made).drop("__range", *(f"__{c}" for c in columns))


def _two_groups(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """A row for each value: how many of either group have it (a, b), and less (before_a, before_b)."""
    some = df.where(F.col(value).isNotNull() & F.col(group).isin(a, b)).groupBy(F.col(value).alias("v"))
    return totals_before(some.agg(*(F.count_if(F.col(group) == g).alias(n) for n, g in (("a", a), ("b", b)))), "v", ["a", "b"])


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """(d): the greatest difference of two groups' distribution functions."""
    n = checkpointed(_two_groups(df, value, group, a, b))
    sizes = n.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    apart = F.abs((F.col("before_a") + F.col("a")) / F.col("na") - (F.col("before_b") + F.col("b")) / F.col("nb"))
    return n.join(F.broadcast(sizes)).agg(F.max(apart).alias("d"))


def mann_whitney(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """(u, z): how often a value of group a beats one of b, ties half; z without correction for ties."""
    n = _two_groups(df, value, group, a, b)
    s = n.agg(F.sum(F.col("a") * (F.col("before_b") + F.col("b") / 2)).alias("u"), F.sum("a").cast("double").alias("na"), F.sum("b").cast("double").alias("nb"))
    na, nb = F.col("na"), F.col("nb")
    return s.select("u", F.try_divide(F.col("u") - na * nb / 2, F.sqrt(na * nb * (na + nb + 1) / 12)).alias("z"))


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """({value}, rank): the average rank of each distinct value among all rows, from 1."""
    n = totals_before(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), value, ["n"])
    return n.select(value, (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rho): the correlation of average ranks, over the rows where both are known."""
    both = df.select(x, y).na.drop().groupBy(x, y).agg(F.count("*").alias("n"))
    rows = df.select(x, y).na.drop()
    ranked = both.join(average_ranks(rows, x).withColumnRenamed("rank", "rx"), x).join(average_ranks(rows, y).withColumnRenamed("rank", "ry"), y)
    n, rx, ry = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    s = ranked.agg(F.sum(n).alias("n"), *(F.sum(n * v).alias(k) for k, v in (("x", rx), ("y", ry), ("xy", rx * ry), ("xx", rx * rx), ("yy", ry * ry))))
    top = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    return s.select(F.try_divide(top, F.sqrt((F.col("xx") - F.col("x") ** 2 / F.col("n")) * (F.col("yy") - F.col("y") ** 2 / F.col("n")))).alias("rho"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """(auc): how often a row of label 1 scores above one of label 0, ties half."""
    s = mann_whitney(df.select(F.col(label).cast("int").alias("__y"), F.col(score).alias("__s")), "__s", "__y", 1, 0)
    n = df.where(F.col(score).isNotNull()).agg((F.count_if(F.col(label) == 1) * F.count_if(F.col(label) == 0)).cast("double").alias("pairs"))
    return s.join(F.broadcast(n)).select(F.try_divide("u", "pairs").alias("auc"))


def numbered(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """df with each row's place by the order, from 0; rows that are equal in the order are numbered in any way."""
    return totals_before(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"]).withColumnRenamed("before___one", out).drop("__one")


def quantiles(df: DataFrame, columns: list[str], shares: list[float], keys: list[str] = ()) -> DataFrame:
    """(keys, column, share, value): exact quantiles, interpolated, of each column in each group; NaN and null are passed over,
    and rows with a null key go.

    Rows are counted by value before the shuffle, the values of all columns and groups are ranked as one long column by
    ranges, and each quantile is found where its rank falls. No task sees a whole column or a whole group.
    """
    keys = list(keys)
    long = df.na.drop(subset=keys) if keys else df
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    long = long.select(*keys, F.explode(cells).alias("__c")).select(*keys, "__c.column", "__c.value").where("value is not null and not isnan(value)")
    group = [*keys, "column"]
    placed = checkpointed(totals_before(long.groupBy(*group, "value").agg(F.count("*").alias("n")), [*group, "value"], ["n"]))
    ends = placed.groupBy(*group).agg(F.min("before_n").alias("__from"), F.sum("n").alias("__n"))
    at = lambda q: F.col("__from") + (F.col("__n") - 1) * F.lit(float(q))
    reached = lambda p: F.max(F.when(F.col("before_n") <= p, F.col("value")))
    found = placed.join(ends, group).groupBy(*group, "__from", "__n").agg(*(reached(f(at(q))).alias(f"__{n}{i}") for i, q in enumerate(shares) for n, f in (("a", F.floor), ("b", F.ceil))))
    part = lambda i, q: F.col(f"__a{i}") + (at(q) - F.floor(at(q))) * (F.col(f"__b{i}") - F.col(f"__a{i}"))
    rows = F.array(*(F.struct(F.lit(float(q)).alias("share"), part(i, q).alias("value")) for i, q in enumerate(shares)))
    return found.select(*group, F.explode(rows).alias("__r")).select(*group, "__r.share", "__r.value")


def quantile_row(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """One row with an array of the quantiles, in the order of `shares`, for each column; null where nothing is known."""
    found = quantiles(df, columns, shares)
    of = lambda c, q: F.max(F.when((F.col("column") == c) & (F.col("share") == F.lit(float(q))), F.col("value")))
    return found.agg(*(F.array(*(of(c, q) for q in shares)).alias(c) for c in columns))
