"""Models made of models: votes, stacks, weighted stumps, bags, and forests that isolate what is odd."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import learning, rows


@dataclass
class Voting:
    """The class that most models say; of several the smallest."""

    models: list

    def predict(self, df: DataFrame) -> DataFrame:
        said = _said(df, self.models)
        votes = F.array(*(F.col(f"__p{i}") for i in range(len(self.models))))
        counts = F.transform(F.array_distinct(votes), lambda v: F.struct((-F.size(F.filter(votes, lambda x: x == v))).alias("n"), v.alias("v")))
        return said.select(*df.columns, F.array_min(counts)["v"].alias("prediction"))


def _said(df: DataFrame, models: list) -> DataFrame:
    """df with each model's prediction as __p0 and so on."""
    for i, m in enumerate(models):
        df = learning.predict(df, m).withColumnRenamed("prediction", f"__p{i}")
    return df


def voting(df: DataFrame, kinds: list[str], features: list[str], label: str) -> Voting:
    return Voting([learning.fit(df, k, features, label) for k in kinds])


def bagging(df: DataFrame, kind: str, features: list[str], label: str, key: str, n: int = 10, seed: int = 0) -> Voting:
    """Models of rows drawn with replacement: each row enters each model a Poisson number of times, by its key."""
    made = []
    for i in range(n):
        u = rows.by_chance(key, seed * 1000 + i) / float(1 << 60)
        times = sum((F.when(u > s, 1).otherwise(0) for s in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462)), F.lit(0))
        drawn = df.withColumn("__n", times).where("__n > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
        made.append(learning.fit(drawn, kind, features, label))
    return Voting(made)


@dataclass
class Stack:
    """A model of the predictions of models."""

    models: list
    top: object

    def predict(self, df: DataFrame) -> DataFrame:
        return learning.predict(_said(df, self.models), self.top).select(*df.columns, "prediction")


def stacking(df: DataFrame, kinds: list[str], features: list[str], label: str, key: str, top: str = "logistic", k: int = 3, seed: int = 0) -> Stack:
    """The upper model learns from predictions for rows that the lower ones were fitted without, fold by fold."""
    dealt, held = df.withColumn("__fold", rows.fold(key, k, seed)), None
    for i in range(k):
        some = dealt.where(F.col("__fold") != i)
        out = _said(dealt.where(F.col("__fold") == i), [learning.fit(some, kind, features, label) for kind in kinds])
        held = out if held is None else held.union(out)
    upper = learning.fit(held, top, [f"__p{i}" for i in range(len(kinds))], label)
    return Stack([learning.fit(df, kind, features, label) for kind in kinds], upper)


@dataclass
class Boosted:
    """Trees whose votes are weighed; of classes 0 and 1."""

    models: list
    weights: list[float]

    def predict(self, df: DataFrame) -> DataFrame:
        said = _said(df, self.models)
        vote = sum(((2 * F.col(f"__p{i}") - 1) * w for i, w in enumerate(self.weights)), F.lit(0.0))
        return said.select(*df.columns, (vote > 0).cast("double").alias("prediction"))


def ada_boost(df: DataFrame, features: list[str], label: str, rounds: int = 10, depth: int = 1) -> Boosted:
    """Each tree learns with more weight on the rows that those before got wrong. The weights follow from the trees so far, so
    they are computed anew in each round and nothing is stored by row."""
    some = df.select(*features, F.col(label).cast("double").alias(label)).na.drop()
    models: list = []
    votes: list[float] = []
    for _ in range(rounds):
        vote = sum(((2 * F.col(f"__p{i}") - 1) * (2 * F.col(label) - 1) * w for i, w in enumerate(votes)), F.lit(0.0))
        weighed = _said(some, models).withColumn("__w", F.exp(-vote)).select(*some.columns, "__w")
        model = learning.fit(weighed, "tree", features, label, maxDepth=depth, weightCol="__w")
        wrong = learning.predict(weighed, model).agg((F.sum(F.when(F.col("prediction") != F.col(label), F.col("__w")).otherwise(0.0)) / F.sum("__w")).alias("e")).first()["e"]
        if wrong is None or wrong >= 0.5:
            break
        models.append(model)
        votes.append(float(0.5 * np.log((1 - max(wrong, 1e-10)) / max(wrong, 1e-10))))
        if wrong <= 1e-10:
            break
    return Boosted(models, votes)


@dataclass
class IsolationForest:
    """Trees of random cuts, each a table of nodes (feature, cut, left, right, size); -1 as feature ends a way."""

    trees: list[np.ndarray]
    size: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Near 1 what few cuts set apart, below 0.5 what is like the rest."""
        depth = np.zeros(len(x))
        for t in self.trees:
            at, level = np.zeros(len(x), np.int64), np.zeros(len(x))
            for _ in range(64):
                feature = t[at, 0].astype(np.int64)
                on = feature >= 0
                if not on.any():
                    break
                go_left = x[np.arange(len(x)), np.maximum(feature, 0)] < t[at, 1]
                at = np.where(on, np.where(go_left, t[at, 2], t[at, 3]).astype(np.int64), at)
                level += on
            depth += level + _usual_depth(t[at, 4])
        return 2.0 ** (-depth / len(self.trees) / max(_usual_depth(np.array([self.size]))[0], 1e-9))


def _usual_depth(n: np.ndarray) -> np.ndarray:
    """How many cuts set a row apart on average among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


def _isolating_tree(x: np.ndarray, rng: np.random.Generator, deepest: int) -> np.ndarray:
    nodes: list[list[float]] = []

    def grow(rows_: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, len(rows_)])
        low, high = (rows_.min(0), rows_.max(0)) if len(rows_) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        open_ = np.flatnonzero(high > low)
        if level < deepest and len(rows_) > 1 and len(open_):
            f = int(rng.choice(open_))
            cut = float(rng.uniform(low[f], high[f]))
            left = grow(rows_[rows_[:, f] < cut], level + 1)
            right = grow(rows_[rows_[:, f] >= cut], level + 1)
            nodes[at] = [f, cut, left, right, len(rows_)]
        return at

    grow(x, 0)
    return np.array(nodes)


def isolation_forest(df: DataFrame, features: list[str], key: str, trees: int = 100, size: int = 256, seed: int = 0) -> IsolationForest:
    """Each tree is grown on `size` rows drawn by their key, trees * size rows at most in all; more add nothing to such trees."""
    some = df.select(key, *(F.col(f).cast("double").alias(f) for f in features)).na.drop()
    drawn = rows.sample(some, trees * size, key, seed).select(*features).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    drawn = drawn[np.lexsort(drawn.T)] if len(drawn) else drawn
    size = min(size, len(drawn))
    grown = [_isolating_tree(drawn[rng.choice(len(drawn), size, replace=False)], rng, int(np.ceil(np.log2(max(2, size))))) for _ in range(trees)] if size else [np.array([[-1, 0, 0, 0, 0]])]
    return IsolationForest(grown, size)


def anomaly(model: IsolationForest, *features: str) -> Column:
    """Each row's score, in Arrow batches; null where a feature is."""

    def of(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns], axis=1)
        known = ~np.isnan(x).any(1)
        out = np.full(len(x), np.nan)
        if known.any():
            out[known] = model.scores(x[known])
        return pd.Series(out).where(known)

    return F.pandas_udf(of, "double")(*(F.col(f).cast("double") for f in features))
