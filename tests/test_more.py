"""Text forms, labels, samples, graphs, ensembles and streams: against brute force, or a task with a known answer."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import registry
from gridloom.functions import statistics as S
from gridloom.operators import aggregate, ensembles, graphs, index, learning, rows, running, sampling
from gridloom.sources import files
from gridloom.streaming import windows as streams


def test_registered_names_are_unique():
    with pytest.raises(ValueError, match="two queries"):
        registry.query("sample_exact")(lambda t: None)


def test_json_lines_come_back(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") / 2).alias("x"))
    files.write_json(df.repartition(3), str(tmp_path / "j"))
    back = files.read_json(spark, str(tmp_path / "j"), ["id", "x"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_text_forms(spark):
    text = 'a,b,c,d\n1,2.5,true,"x, ""y""\nz"\n,3,false,\n'
    df = files.read_csv_from_string(spark, text)
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "boolean"), ("d", "string")]
    assert [tuple(r) for r in df.collect()] == [(1, 2.5, True, 'x, "y"\nz'), (None, 3.0, False, None)]
    assert [tuple(r) for r in files.read_csv_from_string(spark, files.to_csv_string(df)).collect()] == [tuple(r) for r in df.collect()]
    assert files.read_csv_from_string(spark, "1;x\n2;y\n", delimiter=";", has_header=False).columns == ["column_0", "column_1"]
    assert files.read_csv_from_string(spark, "a,b\n").count() == 0 and files.read_csv_from_string(spark, "").count() == 0
    with pytest.raises(ValueError, match="fields"):
        files.read_csv_from_string(spark, "a,b\n1\n")
    found = files.from_json_string(spark, '[{"b": 1, "a": "x"}, {"a": null}]', ["a", "b"])
    assert [tuple(r) for r in found.collect()] == [("x", 1), (None, None)]


def test_made_data_do_not_depend_on_partitions(spark):
    made = [files.make_blobs, files.make_moons, files.make_circles, files.make_spirals, files.make_classification]
    for f in made:
        df = f(spark, 40, [(0, 0), (5, 5)]) if f is files.make_blobs else f(spark, 40)
        again = {tuple(r) for r in df.repartition(7).collect()}
        assert again == {tuple(r) for r in df.coalesce(1).collect()} and len(again) == 40
    ring = files.make_circles(spark, 2000, noise=0.0).withColumn("r", F.hypot("x", "y")).groupBy("label").agg(F.min("r"), F.max("r")).collect()
    assert {r[0]: (round(r[1], 6), round(r[2], 6)) for r in ring} == {0: (1.0, 1.0), 1: (0.5, 0.5)}


def test_quantiles_equal_numpy(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab") if rng.random() > 0.1 else None, rng.choice([None, float("nan"), rng.randint(0, 9), rng.random()])) for _ in range(500)] + [("c", None), ("d", 1.0)]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in data], "k string, v double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    real = lambda v: v is not None and not math.isnan(v)
    for r in running.quantiles(df, ["v"], shares, ["k"]).collect():
        assert r["value"] == pytest.approx(np.quantile([v for k, v in data if k == r["k"] and real(v)], r["share"]))
    assert running.quantile_row(df, ["v"], shares).first()["v"] == pytest.approx(np.quantile([v for _, v in data if real(v)], shares).tolist())
    assert running.quantile_row(df.limit(0), ["v"], [0.5]).first()["v"] == [None]
    assert [tuple(r) for r in aggregate.group_by(df, ["k"], "median", ["v"]).where("k > 'b'").collect()] == [("c", None), ("d", 1.0)]


def test_positions_and_labels(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "i int, v string")
    at = lambda *p: spark.createDataFrame([(x,) for x in p], "position int")
    assert sorted(r["v"] for r in rows.select_rows(df, at(4, 0, 4), ["i"]).collect()) == ["v0", "v4", "v4"]
    with pytest.raises(Exception, match="no row at position"):
        rows.select_rows(df, at(5), ["i"]).collect()
    x = index.set_index(df, ["v", "i"])
    assert x.swaplevel().reset_index().columns == ["level_0", "level_1"] and x.is_unique() and x.reset_index().first()["level_1"] == "0"
    with pytest.raises(ValueError, match="one label"):
        index.set_labels_index(df, spark.createDataFrame([(0, "a")], "position int, label string"), ["i"])


def test_samples_are_exact_and_repeat(spark, monkeypatch):
    df = spark.range(1000).withColumnRenamed("id", "k")
    want = sorted(df.select("k", rows.by_chance("k", 7).alias("h")).collect(), key=lambda r: (r["h"], r["k"]))
    bound = rows._bound
    monkeypatch.setattr(rows, "_bound", lambda *a: bound(*a, most=10))  # so that finer ranges are counted too
    for n in (0, 1, 137, 999, 1000, 5000):
        assert {r["k"] for r in rows.sample(df.repartition(5), n, "k", 7).collect()} == {r["k"] for r in want[:n]}
    assert {r["n"] for r in rows.even_folds(df, 7, "k").groupBy("fold").agg(F.count("*").alias("n")).collect()} <= {142, 143}


def test_latin_hypercube_fills_each_slice(spark):
    found = sampling.latin_hypercube(spark, 50, 3, seed=2).collect()
    for d in range(3):
        assert sorted(int(r[f"x{d}"] * 50) for r in found) == list(range(50))


@pytest.mark.parametrize("n", [2, 7, 300])
def test_largest_triangles_by_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(sampling, "HULL_ROWS", 20)
    rng, target = random.Random(n), 12
    pts = [(float(i), rng.choice([rng.random(), float(rng.randint(0, 3))])) for i in range(n)]
    found = sorted(map(tuple, sampling.largest_triangles(spark.createDataFrame(pts, "x double, y double"), "x", "y", target).collect()))
    if n <= target:
        assert found == pts
        return
    runs = [[] for _ in range(target)]
    for i, p in enumerate(pts):
        runs[0 if i == 0 else target - 1 if i == n - 1 else (i - 1) * (target - 2) // (n - 2) + 1].append(p)
    want = [pts[0]]
    for k in range(1, target - 1):
        a, c = want[-1], np.mean(runs[k + 1], axis=0)
        area = [abs((a[0] - c[0]) * (p[1] - a[1]) - (a[0] - p[0]) * (c[1] - a[1])) for p in runs[k]]
        want.append(runs[k][int(np.argmax(area))])
    assert found == [*want, pts[-1]]


def test_graphs_by_brute_force(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 24), rng.randint(0, 24), float(rng.randint(0, 9))) for _ in range(45)]
    nodes = {x for a, b, _ in edges for x in (a, b)}
    df = spark.createDataFrame(edges, "a int, b int, w double")
    reach = {v: {v} for v in nodes}
    while True:
        more = {v: reach[v].union(*(reach[b] for a, b, _ in edges if a in reach[v])) for v in nodes}
        if more == reach:
            break
        reach = more
    want = {v: min(u for u in reach[v] if v in reach[u]) for v in nodes}
    assert {r["node"]: r["component"] for r in graphs.strong_components(df).collect()} == want
    source = edges[0][0]
    cost = {v: math.inf for v in nodes} | {source: 0.0}
    for _ in nodes:
        for a, b, w in edges:
            cost[b] = min(cost[b], cost[a] + w)
    paths = graphs.shortest_paths(df, spark.createDataFrame([(source,)], "node int")).cache()
    assert {r["node"]: r["cost"] for r in paths.collect()} == {v: c for v, c in cost.items() if c < math.inf}
    far = max((v for v in nodes if cost[v] < math.inf), key=lambda v: cost[v])
    way = graphs.path_to(paths, far)
    step = lambda x, y: min(w for a, b, w in edges if (a, b) == (x, y))
    assert way[0] == source and way[-1] == far and sum(step(x, y) for x, y in zip(way, way[1:], strict=False)) == cost[far]
    assert graphs.path_to(paths, 999) == []


def test_negative_weights(spark):
    source = spark.createDataFrame([(1,)], "node int")
    fine = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (3, 2, -2.0)], "a int, b int, w double")
    assert {r["node"]: r["cost"] for r in graphs.shortest_paths(fine, source).collect()} == {1: 0.0, 3: 1.0, 2: -1.0}
    with pytest.raises(ValueError, match="negative"):
        graphs.shortest_paths(spark.createDataFrame([(1, 2, 1.0), (2, 1, -3.0)], "a int, b int, w double"), source)


def test_long_chains_settle(spark):
    chain = spark.range(105).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = graphs.distances(chain, spark.range(1).select(F.col("id").alias("node")))
    assert found.agg(F.max("dist"), F.count("*")).first()[:] == (105, 106)


@pytest.fixture(scope="module")
def clouds(spark):
    return files.make_classification(spark, 600, 2, 3.0, seed=4).withColumn("y", F.col("label").cast("double")).cache()


def accuracy(df):
    return df.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]


@pytest.mark.parametrize("kind", ["logistic", "naive_bayes", "tree", "forest", "boosted_trees", "linear_svm", "neural_net", "one_vs_rest_logistic"])
def test_classifiers_tell_clouds_apart(clouds, kind):
    settings = {"layers": [2, 4, 2]} if kind == "neural_net" else {}
    train, test = rows.train_test_split(clouds, 0.3, "id", 1)
    assert accuracy(learning.predict(test, learning.fit(train, kind, ["x0", "x1"], "y", **settings))) > 0.95


def test_ensembles_tell_clouds_apart(clouds):
    train, test = rows.train_test_split(clouds, 0.3, "id", 1)
    made = [
        ensembles.voting(train, ["logistic", "tree", "naive_bayes"], ["x0", "x1"], "y"), ensembles.stacking(train, ["tree", "naive_bayes"], ["x0", "x1"], "y", "id"),
        ensembles.ada_boost(train, ["x0", "x1"], "y", rounds=4), ensembles.bagging(train, "tree", ["x0", "x1"], "y", "id", n=3),
    ]
    for m in made:
        assert accuracy(m.predict(test)) > 0.92  # one cut of one feature reaches 0.93


def test_regressions_find_the_weights(spark, tmp_path):
    df = files.make_regression(spark, 500, [2.0, -3.0], bias=1.0, noise=0.01)
    for kind, settings in (("linear", {}), ("ridge", {"regParam": 0.001}), ("lasso", {"regParam": 0.001}), ("elastic_net", {"regParam": 0.001})):
        model = learning.fit(df, kind, ["x0", "x1"], "y", **settings)
        assert model.stages[-1].coefficients.toArray() == pytest.approx([2.0, -3.0], abs=0.05)
    learning.save(model, str(tmp_path / "m"))
    assert learning.predict(df, learning.load(str(tmp_path / "m"))).collect() == learning.predict(df, model).collect()
    assert learning.select_k_best(df.withColumn("up", F.col("y") > 1), ["x0", "x1"], "up", 1) == ["x1"]
    assert learning.uncorrelated(df.withColumn("x2", F.col("x0") * 2), ["x0", "x1", "x2"]) == ["x0", "x1"]
    measure = -F.avg(F.pow(F.col("y") - F.col("prediction"), F.lit(2)))
    best = learning.grid_search(df, "ridge", ["x0", "x1"], "y", "id", 2, measure, {"regParam": [0.0, 50.0]}).collect()
    assert best[0]["settings"] == '{"regParam": 0.0}' and best[0]["score"] > best[1]["score"]
    curve = learning.learning_curve(df, "linear", ["x0", "x1"], "y", "id", [0.1, 1.0], measure).collect()
    assert [r["share"] for r in curve] == [0.1, 1.0]


def test_clusters(spark):
    df = files.make_blobs(spark, 300, [(0, 0), (20, 0), (0, 20)], seed=3)
    for kind in ("kmeans", "gaussian_mixture", "bisecting_kmeans"):
        found = learning.predict(df, learning.fit(df, kind, ["x", "y"], k=3)).groupBy("label", "prediction").count()
        assert found.count() == 3 and learning.silhouette(learning.predict(df, learning.fit(df, kind, ["x", "y"], k=3)), ["x", "y"]) > 0.9


def test_isolation_forest_sets_outliers_apart(spark):
    df = files.make_blobs(spark, 500, [(0, 0)], seed=1).select("id", "x", "y").union(spark.createDataFrame([(1000, 15.0, 15.0), (1001, -12.0, 9.0)], "id long, x double, y double"))
    model = ensembles.isolation_forest(df, ["x", "y"], "id", trees=60)
    found = df.select("id", ensembles.anomaly(model, "x", "y").alias("s")).orderBy(F.desc("s")).limit(2).collect()
    assert {r["id"] for r in found} == {1000, 1001} and found[1]["s"] > 0.6
    assert spark.createDataFrame([(None, 1.0)], "x double, y double").select(ensembles.anomaly(model, "x", "y").alias("s")).first()["s"] is None


def test_logistic_fit_by_newton(spark):
    df = files.make_classification(spark, 400, 1, 1.0, seed=9).withColumn("y", F.col("label").cast("double"))
    data = np.array([(1.0, r["x0"], r["y"]) for r in df.collect()])
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-data[:, :2] @ w))
        w += np.linalg.solve((data[:, :2].T * (p * (1 - p))) @ data[:, :2], data[:, :2].T @ (data[:, 2] - p))
    model = learning.fit(df, "logistic", ["x0"], "y").stages[-1]
    assert [model.intercept, model.coefficients[0]] == pytest.approx(w.tolist(), abs=1e-4)


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(400).select("id", F.sin(F.col("id") * 7).alias("x"))
    r, mean = S.bootstrap_mean(df, "x", "id", 200).first(), df.agg(F.avg("x"), F.stddev("x") / 20).first()
    assert r["low"] < mean[0] < r["high"] and (r["high"] - r["low"]) == pytest.approx(3.92 * mean[1], rel=0.3)


def test_wilcoxon_of_a_known_example(spark):
    pairs = [(125, 110), (115, 122), (130, 125), (140, 120), (140, 140), (115, 124), (140, 123), (125, 137), (140, 135), (135, 145)]
    r = S.wilcoxon(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()
    assert r["w"] == 27.0 and r["z"] == pytest.approx((27 - 22.5) / math.sqrt(71.25))


def run_stream(df, spark, name, tmp_path, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_last_events_of_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "e"))
    shown = run_stream(streams.last_n(streams.replay(spark, str(tmp_path / "e")), 5), spark, "last5", tmp_path, "update")
    want = {}
    for r in streams.last_n(events, 5).collect():
        want.setdefault(r["event_type"], set()).add(r["event_id"])
    last = {}
    for r in shown:
        if r["at"][-1] >= last.get(r["key"], (0, None))[0]:
            last[r["key"]] = (r["at"][-1], set(r["id"]))
    assert {k: ids for k, (_, ids) in last.items()} == want


def test_stream_joined_to_a_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_name")
    events.write.parquet(str(tmp_path / "e2"))
    got = run_stream(streams.enriched(streams.replay(spark, str(tmp_path / "e2")), people, "user_id").select("event_id", "c_name"), spark, "named", tmp_path, "append")
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, streams.enriched(events, people, "user_id").select("event_id", "c_name").collect()), key=repr)


def test_late_and_repeated_events_of_a_stream(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    parts = [
        [(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (1, "2024-01-01 00:10:00", "a", 1.0)],
        [(3, "2024-01-01 09:00:00", "a", 4.0)],
        [(5, "2024-01-01 09:30:00", "a", 16.0)],
        [(4, "2024-01-01 00:20:00", "a", 8.0)],  # over an hour late, and the watermark has passed
        [(6, "2024-01-01 20:00:00", "a", 32.0)], [(7, "2024-01-02 20:00:00", "a", 64.0)],
    ]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    folder = tmp_path / "late"
    folder.mkdir()
    import os
    import time

    for i in range(len(parts)):
        source = next(x for x in os.listdir(tmp_path / f"p{i}") if x.endswith(".parquet"))
        os.rename(tmp_path / f"p{i}" / source, folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (time.time() - 100 + 10 * i,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = run_stream(streams.tumbling(stream, "1 hour"), spark, "hours", tmp_path, "append")
    assert {(r["start"].day, r["start"].hour, r["n"], r["total"]) for r in got} == {(1, 0, 3, 4.0), (1, 9, 2, 20.0), (1, 20, 1, 32.0)}
    once = run_stream(streams.without_repeats(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))), spark, "once", tmp_path, "append")
    assert sorted(r["event_id"] for r in once) == [1, 2, 3, 5, 6, 7]


@pytest.mark.parametrize("few", [0, 3, 10_000])
def test_distances_by_brute_force(spark, few):
    rng = random.Random(8)
    edges = [(i, rng.randrange(i)) for i in range(1, 40) if i % 13] + [(rng.randrange(40), rng.randrange(40)) for _ in range(8)] + [(100, 101)]
    want, todo = {0: 0, 39: 0}, [0, 39]
    while todo:
        n = todo.pop(0)
        for a, b in edges:
            for x, y in ((a, b), (b, a)):
                if x == n and y not in want:
                    want[y] = want[n] + 1
                    todo.append(y)
    found = graphs.distances(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(0,), (39,), (None,)], "node long"), few)
    rows_ = found.collect()
    assert {r["node"]: r["dist"] for r in rows_} == want and len(rows_) == len(want)


def test_a_long_chain(spark):
    found = graphs.distances(spark.range(130).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), spark.range(1).select(F.col("id").alias("node")))
    assert found.count() == 131 and found.agg(F.max("dist")).first()[0] == 130


def test_largest_triangles_of_a_convex_series(spark):
    df = spark.range(300_000).selectExpr("cast(id as double) x", "cast(id * id as double) y")
    rows_ = sampling.largest_triangles(df, "x", "y", 50).collect()
    assert len(rows_) == 50 and [r["x"] for r in rows_] == sorted(r["x"] for r in rows_) and rows_[0]["x"] == 0 and rows_[-1]["x"] == 299_999
