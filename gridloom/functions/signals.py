"""Signals: ordered samples of each key. Filters are sums over neighbours, spectra are plain aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from gridloom.operators import scans


def fir(c: str, taps: list[float], w: WindowSpec) -> Column:
    """Sum of taps[i] times the value i rows before; before the start is 0."""
    return sum((F.lag(F.col(c).cast("double"), i, 0.0).over(w) * float(t) for i, t in enumerate(taps)), F.lit(0.0))


def centred(c: str, taps: list[float], w: WindowSpec) -> Column:
    """An odd number of taps around each row; null where a neighbour is missing."""
    half = len(taps) // 2
    at = lambda k: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)
    return sum((at(k) * float(t) for k, t in zip(range(-half, half + 1), taps, strict=True)), F.lit(0.0))


def smoothing_taps(width: int, degree: int) -> list[float]:
    """Of Savitzky and Golay: the middle value of the polynomial that fits `width` (odd) neighbours best."""
    x = np.arange(width) - width // 2
    return np.linalg.pinv(np.vander(x, degree + 1, increasing=True))[0].tolist()


WINDOWS = {
    "hann": (0.5, 0.5, 0.0),
    "hamming": (0.54, 0.46, 0.0),
    "blackman": (0.42, 0.5, 0.08),
}


def taper(kind: str, at: Column, n: Column) -> Column:
    """A window's weight for row `at` (from 0) of n."""
    a, b, c = WINDOWS[kind]
    turn = 2 * math.pi * at / F.nullif(n - 1, F.lit(0))
    return F.coalesce(a - b * F.cos(turn) + c * F.cos(2 * turn), F.lit(1.0))


def crosses_zero(c: str, w: WindowSpec) -> Column:
    """Whether the sign differs from the row before."""
    return F.coalesce((F.lag(c).over(w) < 0) != (F.col(c) < 0), F.lit(False))


def envelope(c: str, width: int, w: WindowSpec) -> Column:
    """The greatest distance from 0 over the rows around."""
    return F.max(F.abs(c)).over(w.rowsBetween(-(width // 2), width // 2))


def energy(c: str, width: int, w: WindowSpec) -> Column:
    """The root of the mean square over the last rows."""
    return F.sqrt(F.avg(F.col(c) * F.col(c)).over(w.rowsBetween(1 - width, 0)))


def autocorrelation(df: DataFrame, c: str, keys: list[str], order: list[str], lag: int) -> DataFrame:
    """(keys, autocorrelation): centred products with the value `lag` rows before, over n times the variance."""
    known = df.where(F.col(c).isNotNull()).select(*keys, *(x for x in order if x not in keys), F.col(c).cast("double").alias("__x"))
    rows = scans.framed(known, {"__y": lambda w: F.lag("__x", lag).over(w)}, keys, order, before=lag)
    x, y, m, n = F.col("__x"), F.col("__y"), F.avg("__x"), F.count("__x")
    top = F.sum(x * y) - m * (F.sum(F.when(y.isNotNull(), x)) + F.sum(y)) + F.count(y) * m * m
    return rows.groupBy(*keys).agg(F.try_divide(top, n * F.var_pop(x)).alias("autocorrelation"))


def _placed(df: DataFrame, c: str, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, __x, __at, __n): the values, their places from 0 and how many rows their key has, in ranges of each key."""
    rows = df.select(*keys, *(x for x in order if x not in keys), F.col(c).cast("double").alias("__x"), F.lit(1).alias("__one"))
    ranges = scans.Ranges(rows, keys, order)
    both = ranges.accumulated({"__a": ("count", "__one")})
    both = ranges.accumulated({"__b": ("count", "__one")}, backward=True, rows=both)
    return both.select(*keys, "__x", (F.col("__a") - 1).alias("__at"), (F.col("__a") + F.col("__b") - 1).alias("__n"))


def spectrum(df: DataFrame, c: str, keys: list[str], order: list[str], bins: int) -> DataFrame:
    """(keys, bin, re, im, power) of the first frequencies of each key's Fourier transform, in one aggregate."""
    rows = _placed(df.where(F.col(c).isNotNull()), c, keys, order).withColumn("__t", -2 * math.pi * F.col("__at") / F.col("__n"))
    made = [F.struct(F.lit(k).alias("bin"), F.sum(F.col("__x") * F.cos(F.col("__t") * k)).alias("re"), F.sum(F.col("__x") * F.sin(F.col("__t") * k)).alias("im")) for k in range(bins)]
    out = rows.groupBy(*keys).agg(F.array(*made).alias("__s")).select(*keys, F.inline("__s"))
    return out.withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def convolve(df: DataFrame, c: str, keys: list[str], order: list[str], taps: list[float]) -> DataFrame:
    """(keys, at, y): the full convolution, len(taps) - 1 rows longer than each key's signal."""
    rows = _placed(df, c, keys, order)
    spread = rows.select(*keys, "__at", "__x", F.posexplode(F.array(*(F.lit(float(t)) for t in taps))).alias("__i", "__tap"))
    return spread.groupBy(*keys, (F.col("__at") + F.col("__i")).alias("at")).agg(F.sum(F.col("__x") * F.col("__tap")).alias("y"))


def onsets(df: DataFrame, c: str, keys: list[str], order: list[str], width: int, times: float) -> DataFrame:
    """The rows where the energy over the last rows is more than `times` that of one row before."""
    mean = lambda w, a, b: F.sqrt(F.avg(F.col(c) * F.col(c)).over(w.rowsBetween(a, b)))
    made = {"__e": lambda w: mean(w, 1 - width, 0), "__b": lambda w: F.when(F.lag(F.lit(1)).over(w).isNotNull(), mean(w, -width, -1))}
    return scans.framed(df, made, keys, order, before=width).where(F.col("__e") > times * F.col("__b")).drop("__e", "__b")
