"""Expectation and maximisation for mixtures: each round is one aggregate over the rows.

A model says, as columns, how likely a row is under a component with given parameters, and what to add up, weighted by how far each row
belongs to a component; from these sums it makes the component's next parameters. Only sums come to the driver, so rows may be
any number; parameters are literals of the next round's plan, which starts from the table again and doesn't grow.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Model:
    """log_density(parameters) as a column; statistics, columns to add up; update(weight, sums) to parameters."""

    log_density: Callable[[dict[str, float]], Column]
    statistics: dict[str, Column]
    update: Callable[[float, dict[str, float]], dict[str, float]]
    columns: list[str]


def gaussian(columns: list[str], least: float = 1e-9) -> Model:
    """Independent normal columns, with mean_{c} and var_{c} (at least `least`)."""

    def log_density(p):
        return sum((-(F.pow(F.col(c) - p[f"mean_{c}"], F.lit(2)) / p[f"var_{c}"] + math.log(2 * math.pi * p[f"var_{c}"])) / 2 for c in columns), F.lit(0.0))

    def update(n, s):
        out = {}
        for c in columns:
            mean = s[f"x_{c}"] / n
            out |= {f"mean_{c}": mean, f"var_{c}": max(s[f"xx_{c}"] / n - mean * mean, least)}
        return out

    return Model(log_density, {f"x_{c}": F.col(c) for c in columns} | {f"xx_{c}": F.col(c) * F.col(c) for c in columns}, update, columns)


def poisson(c: str) -> Model:
    """Counts with a rate."""
    return Model(lambda p: F.col(c) * math.log(p["rate"]) - p["rate"] - _log_factorial(c), {"x": F.col(c)}, lambda n, s: {"rate": max(s["x"] / n, 1e-12)}, [c])


def _log_factorial(c: str) -> Column:
    """By Stirling's series from 10 on, below it from the whole numbers themselves."""
    x = F.col(c).cast("double")
    z = x + 1
    series = (z - 0.5) * F.log(z) - z + math.log(2 * math.pi) / 2 + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5)))
    return F.when(x < 10, F.log(F.factorial(F.greatest(x, F.lit(0)).cast("int")).cast("double"))).otherwise(series)


def bernoulli(columns: list[str]) -> Model:
    """Independent columns of 0 and 1, with share_{c}."""

    def log_density(p):
        kept = {c: min(max(p[f"share_{c}"], 1e-12), 1 - 1e-12) for c in columns}
        return sum((F.when(F.col(c) == 1, F.lit(math.log(kept[c]))).otherwise(math.log(1 - kept[c])) for c in columns), F.lit(0.0))

    return Model(log_density, {c: F.col(c) for c in columns}, lambda n, s: {f"share_{c}": s[c] / n for c in columns}, columns)


@dataclass
class Mixture:
    model: Model
    weights: list[float]
    parameters: list[dict[str, float]]
    log_likelihoods: list[float]

    def _logs(self) -> list[Column]:
        return [self.model.log_density(p) + math.log(w) if w > 0 else F.lit(-math.inf) for w, p in zip(self.weights, self.parameters, strict=True)]

    def shares(self, df: DataFrame) -> DataFrame:
        """df with log_likelihood and shares: how far a row belongs to each component; null where a column is unknown."""
        known = F.lit(True)
        for c in self.model.columns:
            known &= F.col(c).isNotNull()
        rows = df.withColumn("__l", F.when(known, F.array(*self._logs()))).withColumn("__m", F.array_max("__l"))
        rows = rows.withColumn("log_likelihood", F.col("__m") + F.log(F.aggregate("__l", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("__m")))))
        return rows.withColumn("shares", F.transform("__l", lambda x: F.exp(x - F.col("log_likelihood")))).drop("__l", "__m")


def em(df: DataFrame, model: Model, weights: list[float], parameters: list[dict[str, float]], rounds: int = 100, tolerance: float = 1e-8) -> Mixture:
    """Rounds until the log likelihood changes by no more than tolerance * (1 + its size); it never falls. Rows with an unknown
    column take no part; without any, the start comes back. log_likelihoods has that of the parameters before each round."""
    found = Mixture(model, list(weights), list(parameters), [])
    rows = df.select(*model.columns).na.drop()
    for _ in range(rounds):
        told = found.shares(rows)
        sums = [F.sum(F.col("shares")[j] * v).alias(f"{n}_{j}") for j in range(len(weights)) for n, v in {"n": F.lit(1.0), **{f"s_{k}": v for k, v in model.statistics.items()}}.items()]
        r = told.agg(F.sum("log_likelihood").alias("ll"), F.count("*").alias("rows"), *sums).first()
        if not r["rows"]:
            return found
        found.log_likelihoods.append(r["ll"])
        if len(found.log_likelihoods) > 1 and abs(r["ll"] - found.log_likelihoods[-2]) <= tolerance * (1 + abs(r["ll"])):
            return found
        found.weights = [r[f"n_{j}"] / r["rows"] for j in range(len(weights))]
        found.parameters = [model.update(r[f"n_{j}"], {k: r[f"s_{k}_{j}"] for k in model.statistics}) if r[f"n_{j}"] > 0 else found.parameters[j] for j in range(len(weights))]
    return found
