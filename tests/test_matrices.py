"""Block products against numpy."""

import numpy as np
import pytest

from gridloom.operators import matrices


@pytest.mark.parametrize(("n", "m", "p"), [(7, 3, 5), (300, 40, 270), (5, 5000, 3), (9000, 2, 3), (3, 2, 9000)])
def test_product_equals_numpy(spark, monkeypatch, n, m, p):
    if n < 1000 and m < 1000 and p < 1000:
        monkeypatch.setattr(matrices, "SHARE", 1)
    rng = np.random.default_rng(n)
    a, b = rng.integers(-3, 4, size=(n, m)).astype(float), rng.integers(-3, 4, size=(m, p)).astype(float)
    table = lambda x: spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)] + [(0, 0, None)], "i long, j long, v double")
    found = np.zeros((n, p))
    for r in matrices.product(table(a), table(b)).collect():
        found[r["i"], r["j"]] = r["v"]
    assert (found == a @ b).all()


def test_thin_product_equals_sums(spark, monkeypatch):
    """Few entries at large places, below 0 too, with an inner index and a row that are cut into shares; no pair of blocks is multiplied."""
    for name, most in (("PRODUCTS", 50), ("ENTRIES", 20), ("SIDE", 16)):
        monkeypatch.setattr(matrices, name, most)
    monkeypatch.setattr(matrices, "_multiplied", lambda _: pytest.fail("blocks are multiplied"))
    rng = np.random.default_rng(5)
    near = lambda n: rng.integers(-100_000, 100_000, n) * 7
    inner = near(40)
    a = [*zip(near(300), rng.choice(inner, 300), strict=True), *((int(i), int(inner[0])) for i in near(60)), *((42, int(k)) for k in inner)]
    b = [*zip(rng.choice(inner, 300), near(300), strict=True), *((int(inner[0]), int(j)) for j in near(60))]
    left, right = ([(int(i), int(j), float(v)) for (i, j), v in zip(m, rng.integers(-3, 4, len(m)), strict=True)] for m in (a, b))
    want: dict = {}
    for i, k, v in left:
        for k2, j, w in right:
            if k == k2:
                want[i, j] = want.get((i, j), 0.0) + v * w
    table = lambda m: spark.createDataFrame(m, "i long, j long, v double")
    found = [tuple(r) for r in matrices.product(table(left), table(right)).collect()]
    assert {(i, j): v for i, j, v in found} == {p: v for p, v in want.items() if v} and len(found) == sum(v != 0 for v in want.values())


def test_entries_and_empty(spark):
    df = spark.createDataFrame([(2, 1.0, None), (1, 3.0, 4.0)], "k int, x double, y double")
    assert sorted(map(tuple, matrices.entries(df, ["x", "y"], ["k"]).collect())) == [(0, 0, 3.0), (0, 1, 4.0), (1, 0, 1.0)]
    empty = spark.createDataFrame([], "i long, j long, v double")
    assert matrices.product(empty, matrices.transposed(empty)).count() == 0
