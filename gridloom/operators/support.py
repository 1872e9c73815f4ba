"""Support vector classifiers with any kernel, by decomposition of the dual.

Rows in one place that are of one class are one, whose weight may be as large as theirs together. A round takes the rows that break the
optimum's conditions most, at most `working` of them, to the driver, settles their weights and those of the rows taken before, up to
POOL, among themselves, and brings every row's gradient up to date in its own task by the change of those few: no row meets
all others, and what is broadcast is bounded. Each round is written, so a lost executor repeats at most one.

Keys are unique. Rows with an unknown or infinite key, feature or label take no part; a label above 0 is the positive class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import kernels
from gridloom.operators.running import checkpointed

#: Rows whose gradients a task brings up to date at a time.
ROWS = 4096
#: Rows that are settled together at most; if `working` is more, that many.
POOL = 2048


@dataclass
class SupportVectors:
    kernel: kernels.Kernel
    features: list[str]
    rows: DataFrame  # (id, x, y, weight) of the support vectors; those in one place are one, under the smallest key
    bias: float
    rounds: int

    def predict(self, points: DataFrame, key: str) -> DataFrame:
        """(id, decision, prediction): 1 where the decision is above 0, else -1. Points with an unknown feature are left out."""
        n = max(1, -(-self.rows.count() // kernels.BLOCK))
        dealt = self.rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("b")).agg(F.array_sort(F.collect_list(F.struct("id", "x", (F.col("y") * F.col("weight")).alias("v")))).alias("r"))
        vectors = checkpointed(dealt.select("b", F.flatten("r.x").alias("x"), F.col("r.v").alias("v")))
        found = kernels.decision(points, key, self.features, vectors, self.kernel, self.bias)
        return found.withColumn("prediction", kernels.positive("decision"))


def settle(k: np.ndarray, y: np.ndarray, weights: np.ndarray, gradient: np.ndarray, cost: float | np.ndarray, tolerance: float, steps: int = 100_000) -> np.ndarray:
    """The weights of a few rows that are best while all others stay, by steps along the pair that breaks the conditions most."""
    weights, gradient, cost = weights.copy(), gradient.copy(), np.broadcast_to(np.asarray(cost, float), weights.shape)
    for _ in range(steps):
        v = -y * gradient
        up, low = np.where(y > 0, weights < cost, weights > 0), np.where(y > 0, weights > 0, weights < cost)
        if not up.any() or not low.any():
            break
        i, j = np.where(up, v, -np.inf).argmax(), np.where(low, v, np.inf).argmin()
        if v[i] - v[j] <= tolerance:
            break
        room_i = cost[i] - weights[i] if y[i] > 0 else weights[i]
        room_j = weights[j] if y[j] > 0 else cost[j] - weights[j]
        step = min((v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), room_i, room_j)
        weights[i] = (cost[i] if y[i] > 0 else 0.0) if step == room_i else weights[i] + y[i] * step
        weights[j] = (0.0 if y[j] > 0 else cost[j]) if step == room_j else weights[j] - y[j] * step
        gradient += y * (k[:, i] - k[:, j]) * step
    return weights


def fit(df: DataFrame, key: str, features: list[str], label: str, kernel: kernels.Kernel, cost: float = 1.0, tolerance: float = 1e-3, working: int = 256, rounds: int = 1000) -> SupportVectors:
    """The classifier whose conditions hold to `tolerance`; raises an error if that takes over `rounds` rounds. With one class only there
    are no support vectors and the decision is that class's sign everywhere; without rows it is 0."""
    d = len(features)
    rows = kernels.known(df, key, [*features, label])
    y = F.when(F.col("x")[d] > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    spots = kernels.places(rows.select("id", F.slice("x", 1, d).alias("x"), y.alias("y")), "y")
    state = checkpointed(spots.select("id", "x", "y", (F.lit(float(cost)) * F.col("n")).alias("most"), F.lit(0.0).alias("weight"), F.lit(-1.0).alias("gradient")))
    v, positive, some, room = -F.col("y") * F.col("gradient"), F.col("y") > 0, F.col("weight") > 0, F.col("weight") < F.col("most")
    up, low = (positive & room) | (~positive & some), (positive & some) | (~positive & room)
    pool: dict = {}
    for done in range(rounds + 1):
        high = state.where(up).orderBy(v.desc(), "id").limit(working // 2).collect()
        deep = state.where(low).orderBy(v.asc(), "id").limit(working // 2).collect()
        if not high or not deep:
            found = state.agg(F.avg("y")).first()[0]
            bias = float(np.sign(found)) if found is not None else 0.0
            break
        ends = [-r["y"] * r["gradient"] for r in (high[0], deep[0])]
        if ends[0] - ends[1] <= tolerance:
            free = state.where(some & room).agg(F.avg(v)).first()[0]
            bias = free if free is not None else sum(ends) / 2
            break
        if done == rounds:
            raise ArithmeticError(f"the conditions are broken by {ends[0] - ends[1]} after {rounds} rounds")
        pool |= {r["id"]: (r["x"], r["y"], r["most"], r["weight"], r["gradient"]) for r in high + deep}
        x, sign, most, old, gradient = (np.array([r[c] for r in pool.values()], float) for c in range(5))
        new = settle(kernel(x, x), sign, old, gradient, most, tolerance / 2)
        moved = new != old
        now = {i: w for i, w, m in zip(pool, new.tolist(), moved, strict=True) if m}
        gradient = gradient + sign * (kernel(x, x[moved]) @ (sign * (new - old))[moved])
        # What is kept beyond this round: rows with a weight that may go either way, then those nearest to having one.
        slack = np.where((new > 0) & (new < most), 0, np.abs(gradient))
        kept = np.argsort(slack, kind="stable")[: max(0, max(POOL, working) - working)]
        ids = list(pool)
        pool = {ids[k]: (x[k], sign[k], most[k], new[k], gradient[k]) for k in kept}

        def follow(batches: Iterator[pd.DataFrame], x=x[moved], change=(sign * (new - old))[moved], now=now) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), ROWS):
                    part = b.iloc[at : at + ROWS].copy()
                    part["gradient"] += part["y"] * (kernel(np.stack(part["x"]), x) @ change)
                    part["weight"] = [now.get(i, w) for i, w in zip(part["id"], part["weight"], strict=True)]
                    yield part

        state = checkpointed(state.mapInPandas(follow, state.schema))
    return SupportVectors(kernel, features, state.where("weight > 0").select("id", "x", "y", "weight"), bias, done)
