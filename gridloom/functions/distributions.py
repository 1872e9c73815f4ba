"""Special functions and distributions on columns, in Arrow batches of numpy; null where a value isn't defined."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 1e-300
CLOSE = 1e-15
MOST_TERMS = 20_000

log_gamma = np.frompyfunc(lambda v: math.lgamma(v) if v > 0 else math.nan, 1, 1)
error_rest = np.frompyfunc(math.erfc, 1, 1)


def _continued(term: Callable[[int], tuple], first: np.ndarray) -> np.ndarray:
    """first + a1 / (b1 + a2 / (b2 + ...)), where term(n) gives a and b of step n, by Lentz's method."""
    f = np.where(first == 0, LEAST, first)
    c, d = f.copy(), np.zeros_like(f)
    for n in range(1, MOST_TERMS):
        a, b = term(n)
        d = b + a * d
        c = b + a / c
        d = 1 / np.where(d == 0, LEAST, d)
        c = np.where(c == 0, LEAST, c)
        f = f * c * d
        if np.all(np.abs(c * d - 1) < CLOSE):
            break
    return f


def gamma_below(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of the gamma function's integral that lies below x."""
    a, x = (v.astype(float) for v in np.broadcast_arrays(a, x))
    out = np.where((a > 0) & (x >= 0), 0.0, np.nan)
    front = lambda a, x: np.exp(a * np.log(x) - x - log_gamma(a).astype(float))
    near = (a > 0) & (x > 0) & (x < a + 1)
    if near.any():
        p, q = a[near], x[near]
        total = term = 1 / p
        for n in range(1, MOST_TERMS):
            term = term * q / (p + n)
            total = total + term
            if np.all(term < CLOSE * total):
                break
        out[near] = total * front(p, q)
    far = (a > 0) & (x >= a + 1) & np.isfinite(x)
    if far.any():
        p, q = a[far], x[far]
        below = _continued(lambda n: (-n * (n - p), q + 2 * n + 1 - p), q + 1 - p)
        out[far] = 1 - front(p, q) / below
    out[(a > 0) & (x == np.inf)] = 1.0
    return out


def beta_below(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of the beta function's integral that lies below x."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(a, b, x))
    out = np.where((a > 0) & (b > 0) & (x >= 0) & (x <= 1), np.where(x == 1, 1.0, 0.0), np.nan)
    inside = (a > 0) & (b > 0) & (x > 0) & (x < 1)
    if not inside.any():
        return out
    turned = x > (a + 1) / (a + b + 2)
    p, q, z = (np.where(turned, u, v)[inside] for u, v in ((b, a), (a, b), (1 - x, x)))

    def term(n: int) -> tuple:
        if n == 1:
            return np.ones_like(z), np.ones_like(z)
        m, odd = (n - 1) // 2, n % 2 == 0
        if odd:
            return -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)), np.ones_like(z)
        return m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), np.ones_like(z)

    lg = lambda v: log_gamma(v).astype(float)
    front = np.exp(p * np.log(z) + q * np.log1p(-z) + lg(p + q) - lg(p) - lg(q)) / p
    part = front * _continued(term, np.zeros_like(z))
    out[inside] = np.where(turned[inside], 1 - part, part)
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    """The slope of log gamma for x > 0: stepped up beyond 8, then the asymptotic series."""
    x = np.where(x > 0, x, np.nan).astype(float)
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out = np.where(small, out - 1 / np.where(small, x, 1), out)
        x = np.where(small, x + 1, x)
    v = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - v * (1 / 12 - v * (1 / 120 - v * (1 / 252 - v * (1 / 240 - v / 132))))


def zeta(s: np.ndarray, n: int = 20) -> np.ndarray:
    """Riemann's zeta for s > 1: n terms, and the rest by Euler and Maclaurin."""
    s = np.where(s > 1, s, np.nan).astype(float)
    head = sum(np.power(float(k), -s) for k in range(1, n))
    rest = np.power(float(n), 1 - s) / (s - 1) + np.power(float(n), -s) / 2
    return head + rest + s * np.power(float(n), -s - 1) / 12 - s * (s + 1) * (s + 2) * np.power(float(n), -s - 3) / 720


def bessel_j(order: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of whole orders: the mean of cos(order * t - x * sin t) over a full turn, which even steps give to full precision."""
    order, x = (v.astype(float) for v in np.broadcast_arrays(order, x))
    known = np.isfinite(x) & np.isfinite(order) & (np.abs(x) <= 1e5)
    steps = 64 + 2 * int(np.max(np.abs(np.where(known, x, 0)) + np.abs(np.where(known, order, 0)), initial=0))
    total = np.zeros_like(x)
    for t in np.arange(steps) * (2 * math.pi / steps):
        total += np.cos(order * t - np.where(known, x, 0) * math.sin(t))
    return np.where(known, total / steps, np.nan)


def _normal(x, mean, std):
    return 0.5 * error_rest(-(x - mean) / (std * math.sqrt(2))).astype(float)


def _student(x, dof):
    half = 0.5 * beta_below(dof / 2, np.full_like(x, 0.5), dof / (dof + x * x))
    return np.where(x > 0, 1 - half, half)


def _counts(k, below):
    return np.where(k < 0, 0.0, below)


#: Distribution functions: the value, then the parameters.
CDF = {
    "normal": _normal,
    "lognormal": lambda x, mean, std: np.where(x > 0, _normal(np.log(np.maximum(x, LEAST)), mean, std), 0.0),
    "uniform": lambda x, a, b: np.clip((x - a) / (b - a), 0, 1),
    "exponential": lambda x, rate: np.where(x > 0, -np.expm1(-rate * np.maximum(x, 0)), 0.0),
    "weibull": lambda x, shape, scale: -np.expm1(-np.power(np.maximum(x, 0) / scale, shape)),
    "pareto": lambda x, least, shape: np.where(x > least, 1 - np.power(least / np.maximum(x, least), shape), 0.0),
    "logistic": lambda x, mean, scale: 1 / (1 + np.exp(-(x - mean) / scale)),
    "laplace": lambda x, mean, scale: np.where(x < mean, 0.5 * np.exp(-np.abs(x - mean) / scale), 1 - 0.5 * np.exp(-np.abs(x - mean) / scale)),
    "cauchy": lambda x, mean, scale: 0.5 + np.arctan((x - mean) / scale) / math.pi,
    "gamma": lambda x, shape, rate: gamma_below(shape, np.maximum(x, 0) * rate),
    "chi2": lambda x, dof: gamma_below(dof / 2, np.maximum(x, 0) / 2),
    "beta": lambda x, a, b: beta_below(a, b, np.clip(x, 0, 1)),
    "t": _student,
    "f": lambda x, d1, d2: beta_below(d1 / 2, d2 / 2, d1 * np.maximum(x, 0) / (d1 * np.maximum(x, 0) + d2)),
    "poisson": lambda k, mean: _counts(k, 1 - gamma_below(np.floor(np.maximum(k, 0)) + 1, mean)),
    "binomial": lambda k, n, p: np.where(k >= n, 1.0, _counts(k, beta_below(np.maximum(n - np.floor(np.maximum(k, 0)), 0.5), np.floor(np.maximum(k, 0)) + 1, 1 - p))),
    "geometric": lambda k, p: _counts(k - 1, -np.expm1(np.floor(np.maximum(k, 0)) * np.log1p(-p))),
}

#: Functions of numbers.
FUNCTIONS = {"gamma_below": gamma_below, "beta_below": beta_below, "digamma": digamma, "zeta": zeta, "bessel_j": bessel_j}


def _applied(f: Callable, *columns) -> Column:
    """f of numpy arrays as a column; null if any argument is null or the outcome isn't a number."""

    def of(*vs: pd.Series) -> pd.Series:
        known = np.logical_and.reduce([v.notna().to_numpy() for v in vs])
        out = np.full(len(known), np.nan)
        if known.any():
            with np.errstate(all="ignore"):
                out[known] = f(*(v.to_numpy(dtype=float)[known] for v in vs))
        return pd.Series(out).astype("float64").where(~np.isnan(out), None)

    return F.pandas_udf(lambda *vs: of(*vs), "double")(*((c if isinstance(c, Column) else F.lit(c)).cast("double") for c in columns))


def function(name: str, *columns) -> Column:
    """One of FUNCTIONS, over columns or constants."""
    return _applied(FUNCTIONS[name], *columns)


def cdf(name: str, x: Column, *parameters) -> Column:
    """The probability of a value up to x, of one of CDF."""
    return _applied(CDF[name], x, *parameters)


def above(name: str, x: Column, *parameters) -> Column:
    """The probability of a greater value: the p-value of a statistic x."""
    return 1 - cdf(name, x, *parameters)


def two_sided(t: Column, dof: Column) -> Column:
    """The p-value of Student's t for a difference either way."""
    return 2 * cdf("t", -F.abs(t), dof)


def normal_density(x: Column, mean=0.0, std=1.0) -> Column:
    m, s = (v if isinstance(v, Column) else F.lit(v) for v in (mean, std))
    return F.exp(-F.pow((x - m) / s, F.lit(2)) / 2) / (s * math.sqrt(2 * math.pi))
