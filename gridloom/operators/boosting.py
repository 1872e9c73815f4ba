"""Second-order gradient boosting of trees: each level's gradient and Hessian histograms are one aggregate.

A feature with few values is split midway between any two of them, another at its exact quantiles. Rows are kept as bins; their
sums by node, feature and bin are added up in the tasks before the shuffle, and what comes here is bounded by nodes, features
and bins. A split's gain is (GL² / (HL + penalty) + GR² / (HR + penalty) - G² / (H + penalty)) / 2 - cost, and must be above 0; rows
whose feature is unknown go to the side where they gain more. Of equal gains the first feature, the lowest threshold and the
left side for unknown ones win.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import running
from gridloom.operators.running import checkpointed


@dataclass
class Split:
    feature: int
    bin: int
    threshold: float
    unknown_left: bool
    gain: float
    left: Split | Leaf
    right: Split | Leaf


@dataclass
class Leaf:
    value: float


@dataclass
class Boosting:
    features: list[str]
    loss: str
    rate: float
    base: float
    trees: list[Split | Leaf] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)

        def add(node, rows):
            if isinstance(node, Leaf):
                out[rows] += self.rate * node.value
                return
            v = x[rows, node.feature]
            left = np.where(np.isnan(v), node.unknown_left, v <= node.threshold)
            add(node.left, rows[left])
            add(node.right, rows[~left])

        for t in self.trees:
            add(t, np.arange(len(x)))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the prediction: a value, or with the logistic loss 0 or 1 and the probability of 1. NaN is unknown, as null is."""
        width = len(self.features)

        @F.pandas_udf("double")
        def scored(*columns: pd.Series) -> pd.Series:
            return pd.Series(self.score(np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns], axis=1).reshape(-1, width)))

        raw = scored(*(F.col(c).cast("double") for c in self.features))
        if self.loss == "squared":
            return df.withColumn("prediction", raw)
        return df.withColumn("probability", 1 / (1 + F.exp(-raw))).withColumn("prediction", (F.col("probability") >= 0.5).cast("double"))


def _thresholds(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    found, many = {}, []
    for c in features:
        value = F.col(c).cast("double")
        some = [r[0] for r in df.where(value.isNotNull() & ~F.isnan(value)).select(value.alias("v")).distinct().limit(bins + 1).collect()]
        if len(some) <= bins:
            v = np.unique(some)
            found[c] = (v[1:] + v[:-1]) / 2
        else:
            many.append(c)
    if many:
        row = running.quantile_row(df, many, [i / bins for i in range(1, bins)]).first()
        found.update({c: np.unique(row[c]) for c in many})
    return [found[c] for c in features]


def _node(tree, at: int = 1) -> Column:
    """The number of the leaf that a row of bins reaches: a node's children are 2n and 2n + 1."""
    if tree is None or isinstance(tree, Leaf):
        return F.lit(at if tree is None else 0)
    bin_ = F.col("bins")[tree.feature]
    return F.when(F.when(bin_ < 0, F.lit(tree.unknown_left)).otherwise(bin_ <= tree.bin), _node(tree.left, 2 * at)).otherwise(_node(tree.right, 2 * at + 1))


def _value(tree) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(float(tree.value))
    bin_ = F.col("bins")[tree.feature]
    return F.when(F.when(bin_ < 0, F.lit(tree.unknown_left)).otherwise(bin_ <= tree.bin), _value(tree.left)).otherwise(_value(tree.right))


#: A node with fewer rows is not split.
LEAST_ROWS = 3


def best_split(g: list[np.ndarray], h: list[np.ndarray], penalty: float, cost: float) -> tuple[float, int, int, bool] | None:
    """(gain, feature, bin, unknown to the left) from each feature's sums by bin, the unknown ones' first."""
    best = None
    for f, (gs, hs) in enumerate(zip(g, h, strict=True)):
        if len(gs) < 3:
            continue
        all_g, all_h = gs.sum(), hs.sum()
        for unknown_left in (True, False):
            left_g, left_h = np.cumsum(gs[1:])[:-1], np.cumsum(hs[1:])[:-1]
            if unknown_left:
                left_g, left_h = left_g + gs[0], left_h + hs[0]
            right_g, right_h = all_g - left_g, all_h - left_h
            there = (left_h > 0) & (right_h > 1e-12 * all_h)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)) / 2 - cost
            gain = np.where(there, gain, -np.inf)
            at = int(gain.argmax())
            if gain[at] > 0 and (best is None or gain[at] > best[0] * (1 + 1e-12)):
                best = (float(gain[at]), f, at, unknown_left)
    return best


def fit(df: DataFrame, features: list[str], label: str, rounds: int = 50, depth: int = 3, rate: float = 0.1, penalty: float = 1.0, cost: float = 0.0, loss: str = "squared", bins: int = 256) -> Boosting:
    """loss: squared, or logistic for labels 0 and 1. Rows without a label take no part."""
    rows = df.where(F.col(label).isNotNull())
    edges = _thresholds(rows, features, bins)

    @F.pandas_udf("array<short>")
    def binned(*columns: pd.Series) -> pd.Series:
        at = [np.where(np.isnan(x := c.to_numpy(dtype=float, na_value=np.nan)), -1, np.searchsorted(t, x, side="left")) for c, t in zip(columns, edges, strict=True)]
        return pd.Series(list(np.stack(at, axis=1).astype(np.int16)))

    y = F.col(label).cast("double")
    mean = rows.agg(F.avg(y)).first()[0]
    if mean is None:
        return Boosting(features, loss, rate, 0.0)
    if loss == "squared":
        base, gradient, hessian = mean, F.col("p") - F.col("y"), F.lit(1.0)
    else:
        share = min(max(mean, 0.01), 0.99)
        base = float(np.log(share / (1 - share)))
        q = 1 / (1 + F.exp(-F.col("p")))
        gradient, hessian = q - F.col("y"), q * (1 - q)
    model = Boosting(features, loss, rate, base)
    held = checkpointed(rows.select(y.alias("y"), binned(*(F.col(c).cast("double") for c in features)).alias("bins"), F.lit(base).alias("p")))
    sizes = [len(t) + 1 for t in edges]
    for _ in range(rounds):
        tree = _grow(held.select("bins", gradient.alias("g"), hessian.alias("h")), sizes, edges, depth, penalty, cost)
        model.trees.append(tree)
        held = checkpointed(held.withColumn("p", F.col("p") + rate * _value(tree)))
    return model


def _grow(rows: DataFrame, sizes: list[int], edges: list[np.ndarray], depth: int, penalty: float, cost: float):
    """A tree, level by level; each level reads the rows once."""
    tree: list = [None]
    places = {1: (tree, 0)}
    for level in range(depth + 1):
        at = rows.withColumn("node", _node(tree[0])).where("node > 0")
        if level == depth:
            sums = {r["node"]: (r["g"], r["h"]) for r in at.groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
            for n, (holder, key) in places.items():
                _put(holder, key, Leaf(-sums[n][0] / (sums[n][1] + penalty) if n in sums and sums[n][1] + penalty > 0 else 0.0))
            break
        cells = at.select("node", "g", "h", F.posexplode("bins").alias("f", "b")).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()
        counts = dict.fromkeys(places, 0)
        sums = {n: ([np.zeros(s + 1) for s in sizes], [np.zeros(s + 1) for s in sizes]) for n in places}
        for r in cells:
            sums[r["node"]][0][r["f"]][r["b"] + 1] += r["g"]
            sums[r["node"]][1][r["f"]][r["b"] + 1] += r["h"]
            counts[r["node"]] += r["n"] * (r["f"] == 0)
        following = {}
        for n, (holder, key) in places.items():
            g, h = sums[n]
            found = best_split(g, h, penalty, cost) if counts[n] >= LEAST_ROWS else None
            if found is None:
                total = h[0].sum() + penalty
                _put(holder, key, Leaf(-g[0].sum() / total if total > 0 else 0.0))
                continue
            gain, f, b, unknown_left = found
            split = Split(f, b, float(edges[f][b]), unknown_left, gain, None, None)
            _put(holder, key, split)
            following |= {2 * n: (split, "left"), 2 * n + 1: (split, "right")}
        places = following
        if not places:
            break
    return tree[0]


def _put(holder, key, node) -> None:
    if isinstance(holder, list):
        holder[key] = node
    else:
        setattr(holder, key, node)
