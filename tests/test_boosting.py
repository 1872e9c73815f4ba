"""Boosting against a plain version that tries every threshold on the rows themselves."""

import numpy as np
import pytest

from gridloom.operators import boosting


def plain(x, y, rounds, depth, rate, penalty, cost, loss):
    share = min(max(y.mean(), 0.01), 0.99)
    p = np.full(len(y), y.mean() if loss == "squared" else np.log(share / (1 - share)))
    trees = []

    def grow(rows, g, h, level):
        weight = -g[rows].sum() / (h[rows].sum() + penalty)
        if level == depth:
            return ("leaf", weight), {r: weight for r in rows}
        best = None
        for f in range(x.shape[1] if len(rows) >= boosting.LEAST_ROWS else 0):
            v = x[rows, f]
            values = np.unique(v[~np.isnan(v)])
            for side in (True, False):
                for t in (values[1:] + values[:-1]) / 2:
                    left = np.where(np.isnan(v), side, v <= t)
                    score = lambda part: g[rows[part]].sum() ** 2 / (h[rows[part]].sum() + penalty)
                    gain = (score(left) + score(~left) - score(np.ones(len(rows), bool))) / 2 - cost
                    if gain > 0 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, f, t, side, left)
        if best is None:
            return ("leaf", weight), {r: weight for r in rows}
        _, f, t, side, left = best
        a, pa = grow(rows[left], g, h, level + 1)
        b, pb = grow(rows[~left], g, h, level + 1)
        return ("split", f, side if np.isnan(x[rows, f]).any() else None, a, b), pa | pb

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-p))
        g, h = (p - y, np.ones(len(y))) if loss == "squared" else (q - y, q * (1 - q))
        tree, values = grow(np.arange(len(y)), g, h, 0)
        trees.append(tree)
        p = p + rate * np.array([values[i] for i in range(len(y))])
    return trees, p


def shape(node, x, rows):
    if isinstance(node, boosting.Leaf):
        return ("leaf", pytest.approx(node.value))
    v = x[rows, node.feature]
    left = np.where(np.isnan(v), node.unknown_left, v <= node.threshold)
    return ("split", node.feature, node.unknown_left if np.isnan(v).any() else None, shape(node.left, x, rows[left]), shape(node.right, x, rows[~left]))


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_same_trees_as_a_plain_version(spark, loss):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 3)), 1)
    x[rng.random(x.shape) < 0.1] = np.nan
    y = np.where(np.nan_to_num(x[:, 0]) > 0.2, 3.0, 0) + np.nan_to_num(x[:, 1]) + rng.normal(size=300) * 0.1
    if loss == "logistic":
        y = (y > 1).astype(float)
    names = ["a", "b", "c"]
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (-1, 1.0, 1.0, 1.0, None)], "id int, a double, b double, c double, y double").repartition(3)
    settings = {"rounds": 3, "depth": 3, "rate": 0.3, "penalty": 1.0, "cost": 0.05, "loss": loss}
    model = boosting.fit(df, names, "y", **settings)
    trees, p = plain(x, y, **settings)
    for found, want in zip(model.trees, trees, strict=True):
        assert shape(found, x, np.arange(len(x))) == want
    said = {r["id"]: r for r in model.transform(df).collect()}
    want = p if loss == "squared" else 1 / (1 + np.exp(-p))
    assert [said[i]["prediction" if loss == "squared" else "probability"] for i in range(300)] == pytest.approx(want.tolist())


def test_many_values_are_split_at_quantiles(spark):
    df = spark.range(3000).selectExpr("id", "cast(id as double) x", "if(id < 1000, 1.0, 5.0) y")
    model = boosting.fit(df, ["x"], "y", rounds=20, depth=1, rate=0.5, bins=30)
    errors = model.transform(df).selectExpr("avg(abs(prediction - y)) e").first()["e"]
    assert errors < 0.05 and abs(model.trees[0].threshold - 999.5) < 3


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert boosting.fit(empty, ["x"], "y").trees == []
    flat = spark.createDataFrame([(None, 2.0), (None, 2.0)], "x double, y double")
    model = boosting.fit(flat, ["x"], "y", rounds=1)
    assert [r["prediction"] for r in model.transform(flat).collect()] == [2.0, 2.0]
