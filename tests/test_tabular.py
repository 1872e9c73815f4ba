"""Tabular operators: every query with SQL against DuckDB, and small frames with nulls and ties."""

import math
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom import registry
from gridloom.operators import aggregate, frame, joins, rows, scans, windows
from gridloom.sources import files
from gridloom.streaming import windows as streams


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_duckdb(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got, columns = df.collect(), df.columns
    if name not in registry.ORACLES:
        assert columns
        return
    found = duck.sql(registry.ORACLES[name])
    assert sorted(columns) == sorted(found.columns)
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    order = sorted(columns)
    key = lambda rs: sorted((tuple(_norm(r[c]) for c in order) for r in rs), key=repr)
    assert key(got) == key(want)


def test_null_keys_and_suffixes(spark):
    left = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(None, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert {tuple(r) for r in joins.merge(left, right, ["k"], how="outer", indicator=True).collect()} == {(None, "n", None, "left_only"), (None, None, "x", "right_only"), (1, "a", None, "left_only"), (2, "b", "y", "both"), (3, None, "z", "right_only")}
    assert {r["k"] for r in joins.anti_join(left, right, "k").collect()} == {None, 1}
    assert [r["k"] for r in joins.semi_join(left, right, "k").collect()] == [2]


def test_groups_without_null_keys(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (None, 3.0)], "k int, v double")
    assert [tuple(r) for r in aggregate.group_by(df, ["k"], "sum").collect()] == [(1, 3.0)]
    assert sorted((r["v_mean"] or 0) for r in aggregate.transform(df, ["k"], "mean", ["v"]).collect()) == [0, 1.5, 1.5]


def test_ewm_and_interpolation_pass_over_nulls(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 3.0, None, 6.0, 9.0, None])], "p string, i int, v double")
    assert [r["o"] for r in scans.ewm_mean(df, "v", 3, "o", ["p"], ["i"]).orderBy("i").collect()] == [None, 3.0, None, 4.5, 6.75, None]
    assert [r["o"] for r in windows.interpolate(df, "v", "o", ["p"], ["i"]).orderBy("i").collect()] == [3.0, 3.0, 4.5, 6.0, 9.0, 9.0]


def test_splits_are_exact(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    train, test = rows.train_test_split(df, 0.2, "k", 1)
    a, b = {r["k"] for r in train.collect()}, {r["k"] for r in test.collect()}
    assert len(b) == 21 and not a & b and len(a | b) == 103 and rows.sample(df, 10, "k").count() == 10


def test_frame_checks(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "c string, v int")
    with pytest.raises(KeyError):
        frame.drop_column(df, "x")
    with pytest.raises(ValueError, match="exists"):
        frame.rename_column(df, "c", "v")
    assert [tuple(r) for r in frame.one_hot_encode(df, "c").orderBy("v").collect()] == [(1, True), (2, False)]


def test_csv_and_json_round_trip(spark, tmp_path):
    text = 'name,age,score\n"Al, ""x""\nb",25,88.5\nBob,,92.3\n'
    (tmp_path / "a.csv").write_text(text)
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("name", "string"), ("age", "int"), ("score", "double")] and df.collect()[0]["name"] == 'Al, "x"\nb'
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "out")).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    (tmp_path / "a.json").write_text('[{"b": 1, "a": [1]}, {"b": 2.5}, {}]')
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "a.json"), ["b", "a"]).collect()] == [(1.0, None), (2.5, None), (None, None)]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "events"))
    stream = streams.running_moments(streams.replay(spark, str(tmp_path / "events")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("moments").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    want = {r["event_type"]: r for r in streams.running_moments(events).collect()}
    for r in spark.table("moments").collect():
        assert r["n"] == want[r["event_type"]]["n"] and r["mean"] == pytest.approx(want[r["event_type"]]["mean"]) and r["kurtosis"] == pytest.approx(want[r["event_type"]]["kurtosis"])
    assert len(os.listdir(tmp_path / "events")) > 3


def test_filters_reach_the_scan(spark, sf_dir, capsys):
    registry.QUERIES["filter_project"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "GreaterThan(l_quantity,30.0)" in plan and "l_shipdate" not in plan


def test_normal_cdf(spark):
    from gridloom.functions.statistics import normal_cdf

    r = spark.createDataFrame([(0.0,), (1.96,), (None,)], "x double").select(normal_cdf(F.col("x")).alias("p")).collect()
    assert r[0]["p"] == 0.5 and r[1]["p"] == pytest.approx(0.975, abs=1e-4) and r[2]["p"] is None
