"""Descriptive and inferential statistics as aggregates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import running


def skewness(c: str) -> Column:
    """Adjusted for bias."""
    n = F.count(c)
    return F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1)), n - 2)


def kurtosis(c: str) -> Column:
    """Excess, adjusted for bias."""
    n = F.count(c)
    return F.try_divide(((n + 1) * F.kurtosis(c) + 6) * (n - 1), (n - 2) * (n - 3))


def geometric_mean(c: str) -> Column:
    return F.exp(F.avg(F.ln(c)))


def harmonic_mean(c: str) -> Column:
    return F.try_divide(F.count(c).cast("double"), F.sum(1 / F.col(c)))


def iqr(df: DataFrame, c: str, keys: list[str] = ()) -> DataFrame:
    """(keys, iqr): the distance of the quartiles in each group."""
    at = lambda q: F.max(F.when(F.col("share") == q, F.col("value")))
    return running.quantiles(df, [c], [0.25, 0.75], keys).groupBy(*keys).agg((at(0.75) - at(0.25)).alias("iqr"))


def variation(c: str) -> Column:
    return F.try_divide(F.stddev_samp(c), F.avg(c))


def standard_error(c: str) -> Column:
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def _ends(df: DataFrame, c: str, share: float) -> DataFrame:
    return running.quantile_row(df, [c], [share, 1 - share]).select(F.col(c)[0].alias("__a"), F.col(c)[1].alias("__b"))


def trimmed_mean(df: DataFrame, c: str, share: float) -> DataFrame:
    """The mean without the given share of rows at either end. The cut-offs are exact quantiles of a small aggregate."""
    ends = _ends(df, c, share)
    return df.join(F.broadcast(ends)).where(F.col(c).between(F.col("__a"), F.col("__b"))).agg(F.avg(c).alias("trimmed_mean"))


def welch_t(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """(t, dof) of two groups with unequal variances."""
    of = lambda g: F.when(F.col(group) == g, F.col(value))
    s = df.agg(*(f(of(g)).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    va, vb = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    return s.select(((F.col("m0") - F.col("m1")) / F.sqrt(va + vb)).alias("t"), (F.pow(va + vb, F.lit(2)) / (va * va / (F.col("n0") - 1) + vb * vb / (F.col("n1") - 1))).alias("dof"))


def anova_f(df: DataFrame, value: str, group: str) -> DataFrame:
    """(f, between, within) of one-way analysis of variance, from one row a group."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("w"))
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("w").alias("w"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias("b"))
    return s.select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("f"), F.col("b").alias("between"), F.col("w").alias("within"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, dof) of independence, from the table of counts."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("o"))
    rows, cols = n.groupBy(a).agg(F.sum("o").alias("r")), n.groupBy(b).agg(F.sum("o").alias("c"))
    # A cell adds o^2 / e - 2 o + e. All expected counts add up to the total, as the observed do, so that empty cells need no row.
    met = n.join(rows, a).join(cols, b).agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.sum("o").alias("t"))
    labels = n.agg(((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("dof"))
    return met.join(F.broadcast(labels)).select((F.col("t") * (F.col("s") - 1)).alias("chi2"), "dof")


def _running_extreme(df: DataFrame, order: list[str], c: str, greatest: bool) -> DataFrame:
    """df with __run: the greatest (least) c of the rows so far by the order, by ranges and then within them."""
    f, pick = (F.max, F.greatest) if greatest else (F.min, F.least)
    way = [F.asc(x) if greatest else F.desc(x) for x in order]
    dealt = running.checkpointed(df.repartitionByRange(*way).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ends = dealt.groupBy("__range").agg(f(c).alias("__e")).select("__range", f("__e").over(before).alias("__e"))
    inside = f(c).over(Window.partitionBy("__range").orderBy(*way).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(ends), "__range").withColumn("__run", pick(inside, F.coalesce("__e", inside))).drop("__range", "__e")


def _ranked(df: DataFrame, key: str, p: str) -> DataFrame:
    return running.numbered(df, [p, key], "__rank").join(F.broadcast(df.agg(F.count("*").alias("__n"))))


def holm(df: DataFrame, key: str, p: str) -> DataFrame:
    """Step-down adjusted p-values, for a table of tests of any size."""
    raw = _ranked(df, key, p).withColumn("__raw", F.least(F.lit(1.0), F.col(p) * (F.col("__n") - F.col("__rank"))))
    return _running_extreme(raw, [p, key], "__raw", True).select(*df.columns, F.col("__run").alias("adjusted"))


def normal_cdf(x: Column) -> Column:
    """In Arrow batches, whole arrays at a time, as Spark has no error function."""
    from gridloom.functions import distributions as D

    return D.cdf("normal", x, 0.0, 1.0)


def winsorized_mean(df: DataFrame, c: str, share: float) -> DataFrame:
    """The mean with values beyond the share's quantiles at either end moved to them."""
    ends = _ends(df, c, share)
    return df.where(F.col(c).isNotNull()).join(F.broadcast(ends)).agg(F.avg(F.least(F.greatest(F.col(c), F.col("__a")), F.col("__b"))).alias("winsorized_mean"))


def median_deviation(df: DataFrame, c: str) -> DataFrame:
    """(mad): the median distance from the median."""
    middle = running.quantile_row(df, [c], [0.5]).select(F.col(c)[0].alias("__m"))
    apart = df.join(F.broadcast(middle)).select(F.abs(F.col(c) - F.col("__m")).alias("mad"))
    return running.quantile_row(apart, ["mad"], [0.5]).select(F.col("mad")[0].alias("mad"))


def weighted_variance(value: str, weight: str) -> Column:
    """By the sum of the weights less 1."""
    x, w = F.col(value), F.when(F.col(value).isNotNull(), F.col(weight)).cast("double")
    return F.try_divide(F.sum(w * x * x) - F.try_divide(F.pow(F.sum(w * x), F.lit(2)), F.sum(w)), F.sum(w) - 1)


def one_sample_t(value: str, mean: float) -> Column:
    return F.try_divide(F.avg(value) - mean, F.stddev_samp(value) / F.sqrt(F.count(value)))


def cohens_d(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """(d): the difference of two means over the pooled deviation."""
    of = lambda g: F.when(F.col(group) == g, F.col(value))
    (ma, va, na), (mb, vb, nb) = ((F.avg(of(g)), F.var_samp(of(g)), F.count(of(g))) for g in (a, b))
    return df.agg(F.try_divide(ma - mb, F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))).alias("d"))


SPECIAL = {"erf": math.erf, "erfc": math.erfc, "gamma": math.gamma, "lgamma": math.lgamma}


def special(name: str, x: Column) -> Column:
    """erf, erfc, gamma or lgamma, in Arrow batches; null where it isn't defined or too large."""

    def one(v: float) -> float | None:
        try:
            return SPECIAL[name](v)
        except (ValueError, OverflowError):
            return None

    def of(v: pd.Series) -> pd.Series:
        return v.map(one, na_action="ignore").astype("float64")

    return F.pandas_udf(of, "double")(x)


def bonferroni(df: DataFrame, p: str) -> DataFrame:
    """p times the number of tests, at most 1."""
    n = df.agg(F.count(p).alias("__n"))
    return df.join(F.broadcast(n)).withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * F.col("__n"))).drop("__n")


def benjamini_hochberg(df: DataFrame, key: str, p: str) -> DataFrame:
    """Step-up adjusted p-values for the rate of false discoveries, for a table of tests of any size."""
    raw = _ranked(df, key, p).withColumn("__raw", F.col(p) * F.col("__n") / (F.col("__rank") + 1))
    return _running_extreme(raw, [p, key], "__raw", False).select(*df.columns, F.least(F.lit(1.0), "__run").alias("adjusted"))


def paired_t(a: str, b: str) -> Column:
    d = F.col(a) - F.col(b)
    return F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d)))


def goodness_of_fit(df: DataFrame, c: str, shares: dict) -> DataFrame:
    """(chi2, dof) of a column's counts against the expected shares; values without a share are left out."""
    want = df.sparkSession.createDataFrame([(str(k), float(v)) for k, v in shares.items()], "k string, share double")
    n = df.where(F.col(c).cast("string").isin([str(k) for k in shares])).groupBy(F.col(c).cast("string").alias("k")).agg(F.count("*").cast("double").alias("o"))
    cells = want.join(n, "k", "left").join(F.broadcast(n.agg(F.sum("o").alias("t"))))
    e = F.col("share") * F.col("t")
    return cells.agg(F.sum(F.pow(F.coalesce("o", F.lit(0.0)) - e, F.lit(2)) / e).alias("chi2"), (F.count("*") - 1).alias("dof"))


def brown_forsythe(df: DataFrame, value: str, group: str) -> DataFrame:
    """(f, between, within): analysis of variance of the distances from each group's median, a test of equal spread."""
    middle = running.quantiles(df, [value], [0.5], [group]).select(group, F.col("value").alias("__m"))
    return anova_f(df.join(middle, group).select(group, F.abs(F.col(value) - F.col("__m")).alias(value)), value, group)


def bootstrap_mean(df: DataFrame, c: str, key: str, rounds: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(low, high): an interval of the mean over resampled rows. Each row enters each round a Poisson number of times,
    drawn from its key, so all rounds are sums of one pass."""
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(12)]
    times = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, s: n + F.when(F.xxhash64(F.lit(seed), r, F.col(key)).cast("double") / 2.0**64 + 0.5 > s, 1).otherwise(0)))
    drawn = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("x"), F.posexplode(times).alias("round", "n"))
    means = drawn.groupBy("round").agg(F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum("n")).alias("m"))
    return means.agg(F.percentile("m", F.lit((1 - level) / 2)).alias("low"), F.percentile("m", F.lit((1 + level) / 2)).alias("high"))


def jackknife(c: str) -> list[Column]:
    """(estimate, error) of the mean with one row left out at a time, as aggregates: the algebra needs no resampling."""
    return [F.avg(c).alias("estimate"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("error")]


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """(w, z) of the signed ranks of a - b: the sum of the positive differences' average ranks, pairs without a difference
    left out, and its normal score without correction for ties."""
    d = df.select((F.col(a) - F.col(b)).cast("double").alias("d")).where("d is not null and d <> 0").select(F.abs("d").alias("size"), (F.col("d") > 0).alias("up"))
    counts = running.totals_before(d.groupBy("size").agg(F.count("*").alias("n"), F.count_if("up").alias("up")), "size", ["n"])
    s = counts.agg(F.sum(F.col("up") * (F.col("before_n") + (F.col("n") + 1) / 2)).alias("w"), F.sum("n").cast("double").alias("n"))
    n = F.col("n")
    return s.select("w", F.try_divide(F.col("w") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("z"))


def power_two_sample(effect: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """The share of true effects of so many deviations that two groups of n find, by the normal curve; z is the level's bound."""
    shift = F.abs(effect) * F.sqrt(n / 2)
    return normal_cdf(shift - z) + normal_cdf(-shift - z)


def power_one_sample(effect: Column, n: Column, z: float = 1.959963984540054) -> Column:
    shift = F.abs(effect) * F.sqrt(n)
    return normal_cdf(shift - z) + normal_cdf(-shift - z)


def size_two_sample(effect: Column, z: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> Column:
    """How many each of two groups needs to find an effect with the power that z_power stands for."""
    return F.ceil(2 * F.pow((z + z_power) / effect, F.lit(2)))
