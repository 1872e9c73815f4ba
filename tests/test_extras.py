"""Special functions against known values, further graphs, neighbours and filters on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import distributions as D
from gridloom.functions import finance, signals
from gridloom.functions import statistics as S
from gridloom.operators import graphs, learning, neighbours, rows
from gridloom.operators.windows import ordered
from gridloom.streaming import filters
from gridloom.streaming.windows import replay


def test_special_functions():
    x = np.array([0.1, 1.0, 3.0, 20.0, 300.0])
    assert D.gamma_below(2.0, x) == pytest.approx(1 - np.exp(-x) * (1 + x), abs=1e-13)
    assert D.gamma_below(0.5, x) == pytest.approx([math.erf(math.sqrt(v)) for v in x], abs=1e-13)
    z = np.linspace(0, 1, 21)
    assert D.beta_below(2.0, 3.0, z) == pytest.approx(6 * z**2 - 8 * z**3 + 3 * z**4, abs=1e-12)
    assert D.beta_below(30.0, 0.5, np.array([0.9]))[0] == pytest.approx(1 - D.beta_below(0.5, 30.0, np.array([0.1]))[0], abs=1e-12)
    assert D.digamma(np.array([1.0, 0.5])) == pytest.approx([-0.5772156649015329, -1.9635100260214235], abs=1e-12)
    assert D.zeta(np.array([2.0, 4.0])) == pytest.approx([math.pi**2 / 6, math.pi**4 / 90], abs=1e-10)
    assert D.bessel_j(np.array([0, 1, 2]), np.array([1.0, 1.0, 50.0])) == pytest.approx([0.7651976865579666, 0.4400505857449335, -0.05971280079425882], abs=1e-12)
    assert np.isnan(D.gamma_below(np.array([-1.0]), np.array([1.0])))[0] and np.isnan(D.zeta(np.array([0.5])))[0]


@pytest.mark.parametrize(("name", "x", "parameters", "want"), [
    ("normal", 1.0, (0.0, 1.0), 0.8413447460685429), ("t", 2.0, (1.0,), 0.5 + math.atan(2) / math.pi), ("t", -1.0, (2.0,), 0.5 - 1 / (2 * math.sqrt(3))),
    ("f", 3.0, (2.0, 2.0), 0.75), ("binomial", 1.0, (3.0, 0.5), 0.5), ("binomial", 3.0, (3.0, 0.5), 1.0), ("binomial", -1.0, (3.0, 0.5), 0.0),
    ("geometric", 2.0, (0.5,), 0.75), ("poisson", -1.0, (2.0,), 0.0), ("cauchy", 1.0, (0.0, 1.0), 0.75), ("laplace", 0.0, (0.0, 1.0), 0.5),
    ("weibull", 2.0, (1.0, 2.0), 1 - math.exp(-1)), ("pareto", 2.0, (1.0, 1.0), 0.5), ("uniform", 3.0, (2.0, 6.0), 0.25), ("logistic", 0.0, (0.0, 1.0), 0.5),
    ("lognormal", 1.0, (0.0, 1.0), 0.5), ("gamma", 2.0, (1.0, 0.5), 1 - math.exp(-1)),
])
def test_distributions(spark, name, x, parameters, want):
    df = spark.createDataFrame([(x,), (None,)], "x double").select(D.cdf(name, F.col("x"), *parameters).alias("p"))
    got = sorted((r["p"] for r in df.collect()), key=lambda v: v is None)
    assert got[0] == pytest.approx(want, abs=1e-10) and got[1] is None


def test_components_forest_and_levels(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0), (3, 1, 2.0), (7, 8, 1.0), (8, 9, 1.0), (4, 4, 1.0), (None, 1, 1.0), (2, 1, 6.0)], "a int, b int, w double")
    assert {r["node"]: r["component"] for r in graphs.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert tuple(graphs.cycles(e).first()) == (6, 5, 2, 1)
    assert {r["component"]: r["bipartite"] for r in graphs.bipartite(e).collect()} == {1: False, 7: True}
    assert {tuple(r) for r in graphs.spanning_forest(e).collect()} == {(2, 3, 1.0), (1, 3, 2.0), (7, 8, 1.0), (8, 9, 1.0)}
    d = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (5, 6), (6, 5)], "a int, b int")
    assert {tuple(r) for r in graphs.topological_levels(d).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert graphs.connected_components(e.limit(0)).count() == graphs.spanning_forest(e.limit(0)).count() == graphs.topological_levels(d.limit(0)).count() == 0


def test_forest_is_lightest(spark):
    """Against Kruskal's way on a random graph with many equal weights."""
    rng = np.random.default_rng(3)
    some = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.integers(1, 9, 300), strict=True)]
    root = list(range(60))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    total = n = 0
    for a, b, w in sorted(some, key=lambda t: t[2]):
        if (x := find(a)) != (y := find(b)):
            root[x], total, n = y, total + w, n + 1
    got = graphs.spanning_forest(spark.createDataFrame(some, "a int, b int, w double")).agg(F.sum("w"), F.count("*")).first()
    assert tuple(got) == (total, n)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 12, (400, 2)))] + [(900, None, 1.0)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = neighbours.nearest(df.where("id % 20 = 0"), df, "id", ["x", "y"], 4).collect()
    known = [p for p in points if p[1] is not None]
    for q in known[::20]:
        want = sorted((((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5, p[0]) for p in known if p[0] != q[0])[:4]
        mine = sorted((r for r in got if r["query"] == q[0]), key=lambda r: r["rank"])
        assert [(r["distance"], r["neighbour"]) for r in mine] == want
    assert {r["query"] for r in got} == {p[0] for p in known if p[0] % 20 == 0}
    few = neighbours.nearest(df.limit(3), df.limit(3), "id", ["x", "y"], 4)
    assert few.count() == 6
    voted = neighbours.classify(few, df.withColumn("c", F.col("id") % 2), "id", "c")
    assert {r["query"]: r["prediction"] for r in voted.collect()} == {0: 0, 1: 0, 2: 0}


@pytest.mark.parametrize("d", [1, 2, 9])
def test_nearest_looks_into_few_leaves(spark, monkeypatch, d):
    """Crowded, far and repeated places over many leaves; queries that are no rows; and only a part of all pairs along few columns."""
    for name, n in (("LEAF", 8), ("BLOCK", 16), ("SHARE", 1)):
        monkeypatch.setattr(neighbours, name, n)
    rng = np.random.default_rng(d)
    x = np.concatenate([np.round(rng.normal(size=(900, d)) * 64) / 64, np.zeros((60, d)), 1e3 + rng.integers(0, 4, (40, d))])
    schema = "id long, " + ", ".join(f"c{i} double" for i in range(d))
    table = lambda ids: spark.createDataFrame([(int(i), *map(float, x[i])) for i in ids], schema)
    rows, asked = table(range(970)), np.concatenate([np.arange(0, 970, 9), np.arange(970, 1000)])
    met, packed = [], neighbours._packed
    monkeypatch.setattr(neighbours, "_packed", lambda df, columns, name: (met.append(df.count()) if name == "a" else None, packed(df, columns, name))[1])
    got = neighbours.nearest(table(asked), rows, "id", [f"c{i}" for i in range(d)], 3).collect()
    mine = {(r["query"], r["rank"]): (r["neighbour"], r["distance"]) for r in got}
    off = ((x[asked][:, None] - x[None, :970]) ** 2).sum(2)
    for q, row in zip(asked, off, strict=True):
        want = [i for i in np.lexsort((np.arange(970), row)) if i != q][:3]
        assert [mine[int(q), k + 1][0] for k in range(3)] == want and mine[int(q), 1][1] == pytest.approx(row[want[0]] ** 0.5)
    assert len(got) == 3 * len(asked) and (d > 8 or len(met) == 2 and met[1] < 12 * met[0])


def test_kalman_in_a_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    made = [(i, "ab"[i % 2], 1_700_000_000 + i, None if i % 17 == 5 else float(rng.normal(10, 2))) for i in range(200)]
    df = spark.createDataFrame(made, "event_id long, event_type string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    for part in range(2):
        df.where(f"event_id div 100 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {(r["key"], r["id"]): (r["estimate"], r["variance"]) for r in filters.kalman(df).collect()}
    assert len(batch) == 200
    state = None
    for i, _, _, v in (r for r in made if r[1] == "a"):
        if state is None or v is None:
            state = (v, 1.0) if state is None else (state[0], state[1] + 0.01)
        else:
            gain = (state[1] + 0.01) / (state[1] + 1.01)
            state = (state[0] + gain * (v - state[0]), gain)
        assert batch["a", i] == pytest.approx(state)
    q = filters.kalman(replay(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("kalman_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    rows_ = spark.table("kalman_out").collect()
    # Files may arrive in either order, so only the counts and the first file's agreement are sure.
    assert len(rows_) == 200 and {(r["key"], r["id"]) for r in rows_} == set(batch)


def test_importance_and_folds(spark):
    df = spark.range(600).select("id", (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 97).cast("double").alias("z")).withColumn("y", 3 * F.col("x") + 1)
    model = learning.fit(df, "linear", ["x", "z"], "y")
    found = learning.permutation_importance(df, model, ["x", "z"], "id", -F.avg(F.pow(F.col("y") - F.col("prediction"), F.lit(2))))
    drop = {r["feature"]: r["drop"] for r in found.collect()}
    assert drop["x"] > 1000 and abs(drop["z"]) < 1e-3
    measured = learning.cross_validate(df, "linear", ["x"], "y", "id", 3, learning.regression_measures("y", "prediction")).collect()
    assert [r["fold"] for r in measured] == [0, 1, 2] and all(r["r2"] > 0.999 for r in measured)
    assert learning.varying(df.withColumn("c", F.lit(1)), ["x", "c"]) == ["x"]
    assert sum(r["count"] for r in df.groupBy(rows.fold("id", 3)).count().collect()) == 600


def test_money(spark):
    flows = spark.createDataFrame([("k", 0, -100.0), ("k", 1, 60.0), ("k", 2, 60.0), ("n", 0, 5.0)], "k string, t int, f double")
    rate = {r["k"]: r["rate"] for r in finance.internal_rate(flows, ["k"], "f", "t").collect()}
    assert -100 + 60 / (1 + rate["k"]) + 60 / (1 + rate["k"]) ** 2 == pytest.approx(0, abs=1e-9) and rate["n"] is None
    lit = [F.lit(v) for v in (100.0, 95.0, 0.05, 0.2, 0.5)]
    r = spark.range(1).select(finance.black_scholes_call(*lit).alias("c"), finance.black_scholes_put(*lit).alias("p"), finance.greeks(*lit)["delta"].alias("d")).first()
    assert r["c"] - r["p"] == pytest.approx(100 - 95 * math.exp(-0.025), abs=1e-9) and 0.5 < r["d"] < 1


def test_bootstrap_covers_and_repeats(spark):
    df = spark.range(2000).select("id", (F.col("id") * 7919 % 1000).cast("double").alias("x"))
    a, b = (S.bootstrap_mean(df, "x", "id", 200, seed=4).first() for _ in range(2))
    half = 1.96 * 288.7 / math.sqrt(2000)
    assert tuple(a) == tuple(b) and a["low"] < 499.5 < a["high"] and (a["high"] - a["low"]) / 2 == pytest.approx(half, rel=0.25)


def test_signals_at_the_edges(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, -1.0), (1, 3, 4.0), (2, 1, 5.0)], "k int, t int, x double")
    w = ordered(["k"], ["t"])
    got = df.select("k", "t", signals.fir("x", [1.0, 1.0], w).alias("y"), signals.crosses_zero("x", w).alias("z"), signals.centred("x", [1.0, 0.0, 1.0], w).alias("c"), signals.envelope("x", 3, w).alias("e")).orderBy("k", "t").collect()
    assert [r["y"] for r in got] == [2.0, 1.0, 3.0, 5.0] and [r["z"] for r in got] == [False, True, True, False]
    assert [r["c"] for r in got] == [None, 6.0, None, None] and [r["e"] for r in got] == [2.0, 4.0, 4.0, 5.0]
    weights = spark.range(3).select(signals.taper("hann", F.col("id"), F.lit(3)).alias("w")).collect()
    assert [r["w"] for r in weights] == pytest.approx([0.0, 1.0, 0.0], abs=1e-12)
