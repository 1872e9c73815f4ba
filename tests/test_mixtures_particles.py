"""Mixtures against a plain loop; particles in a stream against a batch and near a Kalman filter."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import mixtures
from gridloom.streaming import filters, particles
from gridloom.streaming.windows import replay


def plain_em(x, weights, parameters, log_density, update, rounds):
    lls = []
    for _ in range(rounds):
        logs = np.stack([np.log(w) + log_density(x, p) for w, p in zip(weights, parameters, strict=True)], axis=1)
        z = np.log(np.exp(logs).sum(1))
        lls.append(z.sum())
        r = np.exp(logs - z[:, None])
        weights, parameters = r.mean(0), [update(x, r[:, j]) for j in range(len(parameters))]
    return weights, parameters, lls


def test_poisson_and_gaussian_mixtures(spark):
    rng = np.random.default_rng(1)
    counts = np.concatenate([rng.poisson(2, 300), rng.poisson(25, 200)]).astype(float)
    df = spark.createDataFrame([(float(v),) for v in counts] + [(None,)], "x double")
    found = mixtures.em(df, mixtures.poisson("x"), [0.5, 0.5], [{"rate": 1.0}, {"rate": 10.0}], rounds=6, tolerance=0)
    density = lambda x, p: x * np.log(p) - p - np.array([math.lgamma(v + 1) for v in x])
    weights, rates, lls = plain_em(counts, [0.5, 0.5], [1.0, 10.0], density, lambda x, r: (r * x).sum() / r.sum(), 6)
    assert found.weights == pytest.approx(weights.tolist()) and [p["rate"] for p in found.parameters] == pytest.approx(rates) and found.log_likelihoods == pytest.approx(lls)
    assert all(b >= a - 1e-9 for a, b in zip(found.log_likelihoods, found.log_likelihoods[1:], strict=False))
    assert found.shares(df).where("x is null and shares is null").count() == 1 and found.shares(df).where("abs(shares[0] + shares[1] - 1) > 1e-9").count() == 0

    x = np.concatenate([rng.normal(0, 1, 200), rng.normal(6, 2, 200)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    found = mixtures.em(df, mixtures.gaussian(["x"]), [0.5, 0.5], [{"mean_x": -1.0, "var_x": 1.0}, {"mean_x": 4.0, "var_x": 1.0}])
    assert len(found.log_likelihoods) < 100 and all(b >= a - 1e-9 for a, b in zip(found.log_likelihoods, found.log_likelihoods[1:], strict=False))
    assert [p["mean_x"] for p in found.parameters] == pytest.approx([0, 6], abs=0.4)


def test_bernoulli_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1, 0)] * 30 + [(0, 0, 1)] * 10, "a int, b int, c int")
    start = [{"share_a": 0.6, "share_b": 0.6, "share_c": 0.4}, {"share_a": 0.4, "share_b": 0.4, "share_c": 0.6}]
    found = mixtures.em(df, mixtures.bernoulli(["a", "b", "c"]), [0.5, 0.5], start)
    assert found.weights == pytest.approx([0.75, 0.25], abs=1e-3)
    assert mixtures.em(df.limit(0), mixtures.bernoulli(["a", "b", "c"]), [0.5, 0.5], start).parameters == start


def test_particles_in_a_stream_equal_a_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    level = np.cumsum(rng.normal(0, 0.1, 240)) + 10
    made = [(i, "ab"[i % 2], 1_700_000_000 + i, None if i % 17 == 5 else float(level[i] + rng.normal())) for i in range(240)]
    df = spark.createDataFrame(made, "event_id long, event_type string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    motion = particles.drifting(0.01, 1.0)
    batch = {(r["key"], r["id"]): tuple(r) for r in particles.particle_filter(df, motion).collect()}
    assert len(batch) == 240
    kalman = {(r["key"], r["id"]): r for r in filters.kalman(df).collect()}
    off = [batch[k][3] - r["estimate"] for k, r in kalman.items()]
    assert np.abs(off).max() < 0.25 and np.abs(off).mean() < 0.05

    first = df.where("event_id < 120").coalesce(1)
    first.write.parquet(str(tmp_path / "in"))
    q = particles.particle_filter(replay(spark, str(tmp_path / "in")), motion).writeStream.format("memory").queryName("particles_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    df.where("event_id >= 120").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert {(r["key"], r["id"]): tuple(r) for r in spark.table("particles_out").collect()} == batch
