"""Draws from distributions and from weighted rows, and the thinning of long series for drawing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import rows, running
from gridloom.sources.files import chance


def latin_hypercube(spark: SparkSession, n: int, dimensions: int, seed: int = 0) -> DataFrame:
    """(id, x0..): n points of which each of n equal slices of every axis holds one."""
    out = spark.range(n)
    for d in range(dimensions):
        dealt = running.numbered(spark.range(n).withColumn("__h", rows.by_chance("id", seed * 1000 + d)), ["__h", "id"], "__slice")
        out = out.join(dealt.select("id", ((F.col("__slice") + chance(seed, d)) / n).alias(f"x{d}")), "id")
    return out


def importance_mean(value: Column, target: Column, proposal: Column) -> Column:
    """The mean of a value under the target density, of rows drawn by the proposal density: an aggregate, weighed by their
    ratio and normed by its sum."""
    return F.try_divide(F.sum(value * target / proposal), F.sum(target / proposal))


def effective_size(weight: Column) -> Column:
    """How many evenly weighed rows the weighed ones are worth, as an aggregate."""
    return F.try_divide(F.sum(weight) * F.sum(weight), F.sum(weight * weight))


def systematic_resample(df: DataFrame, weight: str, order: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows, each drawn in proportion to its weight: at n even steps through the running total of the weights, from one
    start of chance. Rows come as often as steps fall on them."""
    some = df.where(F.col(weight) > 0)
    placed = running.totals_before(some.withColumn("__w", F.col(weight).cast("double")), order, ["__w"])
    total = some.agg(F.sum(weight).cast("double").alias("__t"))
    start = float(np.random.default_rng(seed).random())
    first = lambda x: F.ceil(x / F.col("__t") * n - start)
    times = F.least(first(F.col("before___w") + F.col("__w")), F.lit(n)) - first(F.col("before___w"))
    drawn = placed.join(F.broadcast(total)).withColumn("__n", times.cast("int")).where("__n > 0")
    return drawn.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("draw"))


#: Rows whose hull is taken at a time.
HULL_ROWS = 50_000


def _hull(rows_: pd.DataFrame) -> pd.DataFrame:
    """The corners of the convex hull of rows in the order of x, some of which may lie on an edge."""
    x, y = rows_["x"].to_numpy(), rows_["y"].to_numpy()
    kept: set[int] = set()
    for sign in (1.0, -1.0):
        chain: list[int] = []
        for k in range(len(x)):
            while len(chain) > 1:
                i, j = chain[-2], chain[-1]
                if sign * ((x[j] - x[i]) * (y[k] - y[i]) - (y[j] - y[i]) * (x[k] - x[i])) >= 0:
                    break
                chain.pop()
            chain.append(k)
        kept.update(chain)
    return rows_.iloc[sorted(kept)]


def largest_triangles(df: DataFrame, x: str, y: str, target: int) -> DataFrame:
    """(x, y): `target` rows of a series that keep its look (all rows, if fewer): the first, the last, and of each of
    target - 2 runs of equal length the row that makes the largest triangle with the row taken from the run before and the
    mean of the run after; of several the first.

    Which row wins depends on the row taken before, but it always is a corner of its run's convex hull. So runs are first cut
    down to the corners of their parts of up to HULL_ROWS rows. These are walked along in order by one task, which holds one Arrow
    batch of them and the best row so far; they are few unless the series bends one way throughout, when all of them pass by.
    """
    if target < 2:
        raise ValueError("at least 2 rows")
    some = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    n = some.count()
    if n <= target:
        return some
    placed = running.numbered(some, ["x", "y"], "at")
    run = F.when(F.col("at") == 0, 0).when(F.col("at") == n - 1, target - 1).otherwise(F.floor((F.col("at") - 1) * (target - 2) / (n - 2)) + 1).cast("int")
    placed = running.checkpointed(placed.withColumn("run", run))
    schema, by_place = "run int, at long, x double, y double", lambda rows_: _hull(rows_.sort_values("at"))
    parts = placed.select("run", "at", "x", "y", F.floor(F.col("at") / HULL_ROWS).alias("part")).groupBy("run", "part").applyInPandas(lambda r: by_place(r.drop(columns="part")), schema)
    after = placed.groupBy((F.col("run") - 1).alias("run")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = best = run_ = None  # best: area and place of the best row so far of the run at hand
        for b in batches:
            made = []
            for r, part in b.groupby("run", sort=False):
                if r != run_:
                    if best is not None:
                        taken = best[1]
                        made.append(taken)
                    run_, best = r, None
                if taken is not None and part["mx"].notna().all():
                    area = ((taken[0] - part["mx"]) * (part["y"] - taken[1]) - (taken[0] - part["x"]) * (part["my"] - taken[1])).abs().to_numpy()
                else:
                    area = np.zeros(len(part))
                at = int(area.argmax())
                if best is None or area[at] > best[0]:
                    best = (area[at], (float(part["x"].iloc[at]), float(part["y"].iloc[at])))
            yield pd.DataFrame(made, columns=["x", "y"], dtype="float64")
        yield pd.DataFrame([best[1]] if best is not None else [], columns=["x", "y"], dtype="float64")

    return parts.join(after, "run", "left").repartition(1).sortWithinPartitions("run", "at").mapInPandas(walk, "x double, y double")
