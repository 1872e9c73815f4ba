"""Functions of single numbers, in JVM expressions. Null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column, out: Column) -> Column:
    return F.when(x.isNotNull(), out)


def clamp(x: Column, low: float, high: float) -> Column:
    return known(x, F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def lerp(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def inverse_lerp(a: Column, b: Column, x: Column) -> Column:
    return F.try_divide(x - a, b - a)


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def smootherstep(low: float, high: float, x: Column) -> Column:
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * t * (t * (t * 6 - 15) + 10)


def step(edge: float, x: Column) -> Column:
    return known(x, F.when(x < edge, F.lit(0.0)).otherwise(F.lit(1.0)))


def fract(x: Column) -> Column:
    return x - F.floor(x)


def trunc(x: Column) -> Column:
    """Towards zero."""
    return known(x, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"))


def wrap(x: Column, low: float, high: float) -> Column:
    """Into the range from low to below high, as on a circle."""
    return x - (high - low) * F.floor((x - low) / (high - low))


def snap(x: Column, width: float) -> Column:
    """The nearest multiple of a width."""
    return F.round(x / width) * width


def map_range(x: Column, a: float, b: float, to_a: float, to_b: float) -> Column:
    return F.lit(to_a) + (x - a) * ((to_b - to_a) / (b - a))


def about(a: Column, b: Column, off: float = 1e-9) -> Column:
    """Whether two numbers differ by no more than `off`."""
    return F.abs(a - b) <= off


def gcd(a: Column, b: Column) -> Column:
    """By Euclid's steps, of which two longs take 92 at most."""
    pair = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    once = lambda s, _: F.when(s["y"] == 0, s).otherwise(pair(s["y"], F.when(s["y"] != 0, s["x"] % s["y"])))
    return known(a, known(b, F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair(F.abs(a), F.abs(b)), once, lambda s: s["x"])))


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(known(a, known(b, F.abs(a.cast("long") / gcd(a, b) * b).cast("long"))))


def binomial(n: Column, k: Column) -> Column:
    """How many ways there are to choose k of n, as a double; 0 for k beyond n."""
    few = F.least(k, n - k)
    way = F.aggregate(F.sequence(F.lit(1), F.greatest(few, F.lit(1)).cast("int")), F.lit(1.0), lambda x, i: x * (n - few + i) / i)
    return known(n, known(k, F.when((k < 0) | (k > n), F.lit(0.0)).when(few == 0, F.lit(1.0)).otherwise(F.round(way))))


def isqrt(x: Column) -> Column:
    """The whole part of the square root of a long, exact beyond what doubles hold."""
    root = F.floor(F.sqrt(x.cast("double"))).cast("long")
    return F.when(root * root > x, root - 1).when((root + 1) * (root + 1) <= x, root + 1).otherwise(root)


def is_prime(x: Column, most: int = 1 << 20) -> Column:
    """Whether a whole number up to `most` is prime, by trial division up to its root; null beyond."""
    tries = F.sequence(F.lit(2), F.greatest(F.lit(2), isqrt(x)).cast("int"))
    return F.when(x <= 3, x >= 2).when(x <= most, ~F.exists(tries, lambda d: x % d == 0))
