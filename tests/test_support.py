"""Support vectors against a projected-gradient solution of the whole dual in numpy."""

import numpy as np
import pytest

from gridloom.operators import support
from gridloom.operators.kernels import Kernel


def dual(k, y, cost, rounds=60_000):
    """By accelerated projected gradients on the box and the plane y.w = 0 (bisection for the plane's multiplier)."""
    q = k * np.outer(y, y)
    step = 1 / np.linalg.eigvalsh(q)[-1]

    def onto(w):
        a, b = -1e3, 1e3
        for _ in range(60):
            m = (a + b) / 2
            a, b = (m, b) if (y @ np.clip(w - m * y, 0, cost)) > 0 else (a, m)
        return np.clip(w - (a + b) / 2 * y, 0, cost)

    w = z = np.zeros(len(y))
    t = 1.0
    for _ in range(rounds):
        new = onto(z - step * (q @ z - 1))
        if np.abs(new - w).max() < 1e-10 and np.abs(new - z).max() < 1e-10:
            break
        if (z - new) @ (new - w) > 0:
            t = 1.0
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / u * (new - w), new, u
    return w


def test_equals_the_whole_dual(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 2))
    y = np.where((x**2).sum(1) + rng.normal(0, 0.3, 150) < 1.3, 1.0, -1.0)
    rows = [(i, float(a), float(b), int(c > 0)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1), (901, 1.0, 1.0, None), (None, 1.0, 1.0, 1)], "id long, a double, b double, label int").repartition(4)
    kernel = Kernel("rbf", 0.7)
    model = support.fit(df, "id", ["a", "b"], "label", kernel, cost=2.0, tolerance=1e-6, working=40)
    k = kernel(x, x)
    want = dual(k, y, 2.0)
    got = np.zeros(150)
    for r in model.rows.collect():
        got[r["id"]] = r["weight"]
    assert np.allclose(got, want, atol=1e-3) and set(np.flatnonzero(got > 1e-3)) == set(np.flatnonzero(want > 1e-3)) and model.rounds > 1
    assert abs(y @ got) < 1e-9 and got.min() >= 0 and got.max() <= 2
    found = {r["id"]: r for r in model.predict(df, "id").collect()}
    free = (want > 1e-3) & (want < 2 - 1e-3)
    decision = k @ (want * y)
    bias = (y - decision)[free].mean()
    assert sorted(found) == [*range(150), 901]
    assert np.allclose([found[i]["decision"] for i in range(150)], decision + bias, atol=2e-3)
    assert all(found[i]["prediction"] == (1 if found[i]["decision"] > 0 else -1) for i in found)


@pytest.mark.parametrize(("labels", "want"), [([1, 1, 1], 1.0), ([0, -1, 0], -1.0), ([], 0.0)])
def test_one_class_and_no_rows(spark, labels, want):
    df = spark.createDataFrame([(i, float(i), v) for i, v in enumerate(labels)], "id long, a double, label int")
    model = support.fit(df, "id", ["a"], "label", Kernel())
    asked = spark.createDataFrame([(5, 0.5)], "id long, a double")
    assert [r["decision"] for r in model.predict(asked, "id").collect()] == [want] and model.rows.count() == 0


def test_equal_rows_of_both_classes(spark):
    df = spark.createDataFrame([(i, 1.0, i % 2) for i in range(40)], "id long, a double, label int")
    model = support.fit(df, "id", ["a"], "label", Kernel(), working=8)
    assert abs(model.predict(df, "id").first()["decision"]) < 1e-2


def test_repeated_rows_weigh_as_often_as_they_are(spark, monkeypatch):
    """Each place once up to four times: as the whole dual with all rows, and no more rows are held than there are places."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(70, 2)).repeat(rng.integers(1, 5, 70), axis=0)
    y = np.where((x**2).sum(1) + np.sin(9 * x[:, 0]) < 1.3, 1.0, -1.0)
    df = spark.createDataFrame([(i, float(a), float(b), int(c > 0)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, label int")
    held, written = [], support.checkpointed
    monkeypatch.setattr(support, "checkpointed", lambda d: (held.append(d.count()), written(d))[1])
    kernel = Kernel("rbf", 0.7)
    model = support.fit(df, "id", ["a", "b"], "label", kernel, cost=2.0, tolerance=1e-6, working=20)
    assert max(held) == 70
    k = kernel(x, x)
    want = dual(k, y, 2.0)
    found = {r["id"]: r["decision"] for r in model.predict(df, "id").collect()}
    free = (want > 1e-3) & (want < 2 - 1e-3)
    decision = k @ (want * y)
    assert np.allclose([found[i] for i in range(len(x))], decision + (y - decision)[free].mean(), atol=2e-3)
    assert model.rows.selectExpr("sum(weight)").first()[0] == pytest.approx(want.sum(), rel=1e-3)


def test_query_tells_the_parts_apart(spark, sf_dir):
    from gridloom.registry import QUERIES

    found = QUERIES["support_vectors_parts"](spark, sf_dir)
    assert found.count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert found.where("(prediction > 0) = (label = 1)").count() >= 0.97 * found.count()
