"""Clusters by density and by single linkage, against brute force."""

import numpy as np
import pytest

from gridloom.operators import clusters


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def framed(spark, x):
    """Rows in a mixed order, so that ids don't follow places."""
    ids = np.random.default_rng(7).permutation(len(x))
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [(int(i), *(float(v) for v in r)) for i, r in zip(ids, x, strict=True)]
    return spark.createDataFrame([*rows, (None, *rows[0][1:]), (10_000_000, *([None] * len(names)))], "id long, " + ", ".join(f"{n} double" for n in names)), names, ids


def brute_density(x, ids, eps, least):
    off = distances(x) <= eps
    core, label = off.sum(1) >= least, {}
    for i in sorted(range(len(x)), key=lambda i: ids[i]):
        if core[i] and i not in label:
            todo, label[i] = [i], int(ids[i])
            while todo:
                for k in np.flatnonzero(off[todo.pop()] & core):
                    if k not in label:
                        label[k] = int(ids[i])
                        todo.append(k)
    for i in range(len(x)):
        near = [label[k] for k in np.flatnonzero(off[i] & core)]
        yield int(ids[i]), label[i] if core[i] else min(near, default=None), bool(core[i])


def shapes():
    rng = np.random.default_rng(0)
    turn = rng.random(200) * np.pi
    moons = np.concatenate([np.c_[np.cos(turn), np.sin(turn)], np.c_[1 - np.cos(turn), 0.5 - np.sin(turn)]]) + rng.normal(size=(400, 2)) * 0.05
    yield pytest.param(moons, 0.12, 5, id="moons")
    yield pytest.param(np.array([(i, j) for i in range(15) for j in range(15) if (i * j) % 7], dtype=float), 1.0, 4, id="lattice")
    yield pytest.param(rng.integers(0, 400, size=(300, 1)).astype(float), 1.0, 3, id="line")
    yield pytest.param(rng.random((300, 3)), 0.18, 4, id="cube")


@pytest.mark.parametrize(("x", "eps", "least"), [*shapes()])
def test_dbscan_equals_brute_force(spark, x, eps, least):
    df, names, ids = framed(spark, x)
    found = clusters.dbscan(df, "id", names, eps, least).collect()
    assert sorted(map(tuple, found)) == sorted(brute_density(x, ids, eps, least))


def test_boxes_are_split_until_they_decide(spark, monkeypatch):
    monkeypatch.setattr(clusters, "ENOUGH", 0)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 2)) * 0.05, rng.normal(size=(150, 2)) * 0.05 + [0.5, 0], rng.random((50, 2)) * 3])
    df, names, ids = framed(spark, x)
    assert sorted(map(tuple, clusters.dbscan(df, "id", names, 0.3, 5).collect())) == sorted(brute_density(x, ids, 0.3, 5))


def test_a_dense_cell_stays_linear(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.random((60_000, 2)) * 0.1, 5 + rng.random((60_000, 2)) * 0.1, rng.random((500, 2)) * 100])
    df, names, _ = framed(spark, x)
    found = clusters.dbscan(df, "id", names, 1.0, 5)
    assert found.where("core").count() >= 120_000 


def kruskal(x, ids):
    off, up = distances(x), list(range(len(x)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    joins = []
    for w, i, j in sorted((off[i, j], i, j) for i in range(len(x)) for j in range(i)):
        a, b = root(i), root(j)
        if a != b:
            up[a] = b
            joins.append((w, int(ids[i]), int(ids[j])))
    return joins


def parts(joins, ids):
    name = {int(i): int(i) for i in ids}
    for _, a, b in joins:
        low, high = sorted((name[a], name[b]))
        name = {k: low if v == high else v for k, v in name.items()}
    return name


def test_single_linkage_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([*(rng.normal(size=(30, 2)) * 0.1 + c for c in ((0, 0), (3, 1), (1, 5))), np.full((20, 2), 2.5)])
    df, names, ids = framed(spark, x)
    joins = kruskal(x, ids)
    assert sorted(r["w"] for r in clusters.linkage(df, "id", names).collect()) == pytest.approx([w for w, _, _ in joins])
    found = {r["id"]: r["cluster"] for r in clusters.agglomerative(df, "id", names, clusters=4).collect()}
    assert found == parts(joins[:-3], ids)


def test_single_linkage_by_distance_and_spark_rounds(spark):
    x = np.array([[i * i / 10] for i in range(12)])
    df, names, ids = framed(spark, x)
    found = {r["id"]: r["cluster"] for r in clusters.agglomerative(df, "id", names, distance=1.2).collect()}
    assert found == parts([j for j in kruskal(x, ids) if j[0] <= 1.2], ids)
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.7), (1, 3, 0.9), (4, 5, 0.1)], "a long, b long, w double")
    assert [sorted(map(tuple, df.collect())) for df in clusters._forest(edges, 0)] == [sorted(map(tuple, df.collect())) for df in clusters._forest(edges, 10)]


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, c0 double")
    assert clusters.dbscan(df, "id", ["c0"], 1.0, 3).count() == 0 and clusters.agglomerative(df, "id", ["c0"], clusters=2).count() == 0


@pytest.mark.parametrize("d", [1, 2])
def test_clusters_of_a_distance_need_no_joins(spark, monkeypatch, d):
    """Chains, rows in one place, steps of just the distance, and rows without a value; no join of linkage is made."""
    monkeypatch.setattr(clusters, "linkage", lambda *_: pytest.fail("all joins are made"))
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros((5, d)), np.outer(np.arange(1, 9) * 0.5, np.eye(d)[0]), rng.integers(0, 60, (120, d)) / 2 + 20])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(999, *[None] * d)], "id long, " + ", ".join(f"c{k} double" for k in range(d)))
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.5
    name = np.arange(len(x))
    while True:
        new = np.where(near, name[None], len(x)).min(1)
        if (new == name).all():
            break
        name = new
    found = {r["id"]: r["cluster"] for r in clusters.agglomerative(df, "id", [f"c{k}" for k in range(d)], distance=0.5).collect()}
    assert found == dict(enumerate(name.tolist()))
