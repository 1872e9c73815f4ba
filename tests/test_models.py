"""Graphs, ranks and models on small frames."""

from pyspark.sql import functions as F

from gridloom.operators import graphs, learning, running


def test_distances_and_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (8, 9, 1.0), (3, None, 1.0), (2, 2, 1.0)], "a int, b int, w double")
    start = spark.createDataFrame([(1,)], "node int")
    assert {r["node"]: r["dist"] for r in graphs.distances(e, start).collect()} == {1: 0, 2: 1, 3: 1}
    assert {r["node"]: r["cost"] for r in graphs.shortest_paths(e, start).collect()} == {1: 0.0, 2: 1.0, 3: 2.0}
    assert graphs.triangles(e).first()["n"] == 1


def test_page_rank_adds_up(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (1, 3)], "a int, b int")
    ranks = {r["node"]: r["rank"] for r in graphs.page_rank(e, 10).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[3] > ranks[2] > ranks[1]
    assert graphs.page_rank(e.limit(0)).count() == 0


def test_totals_before_and_auc(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(2).alias("n"))
    assert running.totals_before(df, "k", ["n"]).where("before_n <> 2 * k").count() == 0
    scored = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (0, None)], "y int, s double")
    assert running.auc(scored, "y", "s").first()["auc"] == 0.875


def test_scaling_without_spread(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 4.0)], "x double, y double")
    assert [r["x"] for r in learning.standardize(df, ["x"]).collect()] == [0.0, 0.0] == [r["x"] for r in learning.robust_scale(df, ["x"]).collect()]
    assert [r["y"] for r in learning.impute(df, ["y"], "median").collect()] == [4.0, 4.0]
