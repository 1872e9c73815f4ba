"""Ordered columns over many ranges: against one window over all rows, and a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import signals
from gridloom.operators import joins, scans, windows


@pytest.fixture
def many_ranges(spark):
    """Small frames over 13 ranges, some of them of a few rows."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = [(rng.choice(["a"] * 6 + ["b", "c", None]), i, None if rng.random() < 0.2 else round(rng.random() * 10, 1)) for i in range(700)]
    rng.shuffle(made)
    return spark.createDataFrame(made, "p string, i int, v double").cache()


def same(found, want, *columns):
    a, b = ({r["i"]: r for r in df.collect()} for df in (found, want))
    assert len(a) == 700 and a.keys() == b.keys()
    for i in a:
        for c in columns:
            assert a[i][c] == (None if b[i][c] is None else pytest.approx(b[i][c])), (i, c)


PARTITIONS = [pytest.param([], id="whole"), pytest.param(["p"], id="keys")]


@pytest.mark.parametrize("keys", PARTITIONS)
def test_running_values(spark, many_ranges, rows, keys):
    w = windows.ordered(keys, ["i"])
    ranges = scans.Ranges(rows, keys, ["i"])
    assert ranges.count == 13
    for op, f in (("sum", windows.cumsum), ("product", windows.cumprod), ("mean", lambda c, w: windows.expanding("mean", c, w)), ("var", lambda c, w: windows.expanding("var", c, w))):
        same(scans.cumulative(rows, op, "v", "o", keys, ["i"]), rows.withColumn("o", f("v", w)), "o")
    same(scans.drawdown(rows, "v", "o", keys, ["i"]), rows.withColumn("o", windows.drawdown("v", w)), "o")


def test_log_of_a_product_beyond_doubles(spark, many_ranges):
    values = [1e300, None, 1e300, 2.0, 1e-300, 1e-300, 1e-300, 1e-300, 0.5, 0.0, 3.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    found = [r["o"] for r in scans.cumulative(df, "log_product", "v", "o", [], ["i"]).orderBy("i").collect()]
    big = np.log(1e300)
    want = [big, None, 2 * big, 2 * big + np.log(2), big + np.log(2), np.log(2), np.log(2) - big, np.log(2) - 2 * big, -2 * big, None, None]
    assert found == [None if w is None else pytest.approx(w, rel=1e-14) for w in want]


def test_growth_of_many_rows(spark, tmp_path):
    """Enough lines, of large quantities, that their product is beyond doubles: whole_cumprod takes its logarithm."""
    from gridloom import registry

    lines = spark.range(4000).select(*(F.col("id").alias(c) for c in ("l_orderkey", "l_suppkey")), F.lit(1).alias("l_linenumber"), (F.col("id") * 10).alias("l_partkey"), F.lit(1e6).alias("l_quantity"), *(F.lit(0.0).alias(c) for c in ("l_extendedprice", "l_discount", "l_tax")), F.timestamp_seconds("id").alias("l_shipdate"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = [r["growth"] for r in registry.QUERIES["whole_cumprod"](spark, str(tmp_path)).orderBy("l_orderkey").collect()]
    assert found == pytest.approx([(i + 1) * np.log(2) for i in range(4000)], abs=1e-6)


@pytest.mark.parametrize("keys", PARTITIONS)
def test_frames(spark, many_ranges, rows, keys):
    w = windows.ordered(keys, ["i"])
    made = {"r": lambda w: windows.rolling("mean", "v", 3, w), "d": lambda w: windows.diff("v", w), "s": lambda w: windows.shift("v", -2, w), "e": lambda w: signals.envelope("v", 5, w)}
    want = rows
    for n, f in made.items():
        want = want.withColumn(n, f(w))
    same(scans.framed(rows, made, keys, ["i"], 2, 2), want, *made)
    # Wider than several ranges together.
    same(scans.framed(rows, {"m": lambda w: windows.moving_average("v", 250, w)}, keys, ["i"], 249), rows.withColumn("m", windows.moving_average("v", 250, w)), "m")


@pytest.mark.parametrize("keys", PARTITIONS)
def test_fills(spark, many_ranges, rows, keys):
    for method in ("forward", "backward", "linear"):
        same(scans.filled(rows, "v", "o", keys, ["i"], method), windows.interpolate(rows, "v", "o", keys, ["i"], method), "o")


@pytest.mark.parametrize("keys", PARTITIONS)
def test_ranks(spark, many_ranges, rows, keys):
    for method in ("average", "min", "max", "dense"):
        same(scans.rank(rows, "v", "o", keys, method), rows.withColumn("o", windows.rank("v", keys, method)), "o")
    if not keys:
        same(scans.qcut(rows, "v", 7, "o", ["i"]), rows.withColumn("o", windows.qcut("v", 7, [], ["i"])), "o")


@pytest.mark.parametrize("keys", PARTITIONS)
def test_models_follow_every_key(spark, many_ranges, rows, keys):
    ewm = {r["i"]: r for r in scans.ewm_mean(rows, "v", 5, "o", keys, ["i"]).collect()}
    level = {r["i"]: r for r in scans.local_level(rows, "v", "o", keys, ["i"], 0.01, 1.0).collect()}
    assert len(ewm) == len(level) == 700
    mean, state = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["i"]):
        k, v, i = r["p"] if keys else 0, r["v"], r["i"]
        if v is not None:
            mean[k] = v if k not in mean else mean[k] * 2 / 3 + v / 3
        assert ewm[i]["o"] == (None if v is None else pytest.approx(mean[k]))
        if k not in state:
            if v is not None:
                state[k] = (v, 1.0)
        elif v is None:
            state[k] = (state[k][0], state[k][1] + 0.01)
        else:
            gain = (state[k][1] + 0.01) / (state[k][1] + 1.01)
            state[k] = (state[k][0] + gain * (v - state[k][0]), gain)
        assert (level[i]["o"], level[i]["o_variance"]) == (pytest.approx(state[k]) if k in state else (None, None))


def test_as_of_with_a_hot_key(spark, many_ranges):
    rng = random.Random(4)
    left = [("hot" if rng.random() < 0.7 else rng.choice(["x", "y", None]), rng.randrange(300), i) for i in range(400)]
    right = [(rng.choice(["hot", "x", None]), rng.randrange(300), 1000 + i, rng.random()) for i in range(200)]
    a, b = spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, t int, id int, v double")
    found = {r["id"]: r["v_as_of"] for r in joins.as_of(a, b, "k", "t", "v", "id").collect()}
    for k, t, i in left:
        before = [(r[1], r[2], r[3]) for r in right if r[0] == k and r[1] <= t]
        assert found[i] == (max(before)[2] if before else None)
    few = joins.as_of(a.where("k = 'x'").limit(1), b.where("k = 'y'"), "k", "t", "v", "id").collect()
    assert [r["v_as_of"] for r in few] == [None]


def test_signals_of_hot_keys(spark, many_ranges, rows):
    x = np.array([r["v"] for r in sorted(rows.where("p = 'a' and v is not null").collect(), key=lambda r: r["i"])])
    d = x - x.mean()
    found = signals.autocorrelation(rows.where("p = 'a'"), "v", ["p"], ["i"], 2).collect()[0]["autocorrelation"]
    assert found == pytest.approx((d[2:] * d[:-2]).sum() / (d * d).sum())
    power = {r["bin"]: r["power"] for r in signals.spectrum(rows.where("p = 'a'"), "v", ["p"], ["i"], 4).collect()}
    assert [power[k] for k in range(4)] == pytest.approx((abs(np.fft.fft(x)[:4]) ** 2).tolist())
    y = {r["at"]: r["y"] for r in signals.convolve(rows.where("p = 'a' and v is not null"), "v", ["p"], ["i"], [0.5, 0.25, 0.1]).collect()}
    assert [y[i] for i in range(len(x) + 2)] == pytest.approx(np.convolve(x, [0.5, 0.25, 0.1]).tolist())


def test_no_task_holds_the_column(spark, many_ranges, capsys):
    lineitem = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    ranges = scans.Ranges(lineitem.select(*order), [], order)
    assert len(ranges.sizes) == 13 and max(ranges.sizes.values()) < 2 * sum(ranges.sizes.values()) / 13
    ranges.accumulated({"s": ("sum", "l_extendedprice")}).explain()
    plan = capsys.readouterr().out
    # The one window over everything is that of one row a range.
    assert plan.count("Exchange SinglePartition") == 1 and "shufflepartitionidpassthrough" in plan


def test_no_rows(spark):
    empty = spark.createDataFrame([], "p string, i int, v double")
    for df in (scans.cumulative(empty, "sum", "v", "o", [], ["i"]), scans.framed(empty, {"o": lambda w: F.lag("v").over(w)}, ["p"], ["i"], 1), scans.filled(empty, "v", "o", [], ["i"], "linear"), scans.ewm_mean(empty, "v", 3, "o", [], ["i"]), scans.rank(empty, "v", "o"), scans.qcut(empty, "v", 4, "o", ["i"])):
        assert df.count() == 0 and "o" in df.columns
