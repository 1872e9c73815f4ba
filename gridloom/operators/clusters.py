"""Clusters by density and by single linkage, exact, without all pairs.

Both lay a grid over the rows and look at neighbouring cells only; how near two groups of rows are is found by boxes that are made
smaller where they don't decide. A grid has some (2 sqrt(d) + 3)^d neighbours a cell, so this is for few columns.

Keys are whole numbers and unique; rows with an unknown key or feature take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import graphs, scans
from gridloom.operators.running import checkpointed

#: Rows of a cell that are held against others at a time.
BLOCK = 4096
#: So many distances are computed without splitting boxes any further.
ENOUGH = 5_000_000
#: Columns up to which clusters of a distance are found over a grid, whose cells have up to 5, 21 and 89 neighbours then.
GRID = 3
#: Room for rounding in bounds.
MORE = 1 + 1e-9


def _points(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(id, x) of the rows that take part."""
    x = F.array(*(F.col(c).cast("double") for c in features))
    return df.select(F.col(key).cast("long").alias("id"), x.alias("x")).where("id is not null").where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))


def _cell(side: float, x: str = "x") -> Column:
    return F.transform(x, lambda v: F.floor(v / F.lit(side)))


def _around(d: int, side: float, reach: float) -> Column:
    """The steps to cells that may hold something within reach."""
    far = int(reach / side * MORE) + 1
    near = [o for o in product(range(-far, far + 1), repeat=d) if sum((max(abs(k) - 1, 0) * side) ** 2 for k in o) <= (reach * MORE) ** 2]
    return F.array(*(F.array(*(F.lit(k).cast("long") for k in o)) for o in near))


def _moved(cell: str, step: str) -> Column:
    return F.zip_with(cell, step, lambda a, b: a + b)


def _far(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _boxes(rows: DataFrame, keys: list[str], d: int) -> DataFrame:
    """(keys, lo, hi, n): the least and greatest of each coordinate."""
    ends = {n: F.array(*(f(F.col("x")[i]) for i in range(d))).alias(n) for n, f in (("lo", F.min), ("hi", F.max))}
    return rows.groupBy(*keys).agg(ends["lo"], ends["hi"], F.count("*").alias("n"))


def _bounds(d: int) -> dict[str, Column]:
    """The least and the greatest distance between two boxes (a_lo, a_hi), (b_lo, b_hi)."""
    gap = [F.greatest(F.lit(0.0), F.col("a_lo")[i] - F.col("b_hi")[i], F.col("b_lo")[i] - F.col("a_hi")[i]) for i in range(d)]
    span = [F.greatest(F.abs(F.col("a_hi")[i] - F.col("b_lo")[i]), F.abs(F.col("b_hi")[i] - F.col("a_lo")[i])) for i in range(d)]
    root = lambda xs: F.sqrt(sum((x * x for x in xs), F.lit(0.0)))
    return {"least": root(gap), "most": root(span)}


def closest(points: DataFrame, pairs: DataFrame, d: int, side: float, within: float, settle: bool) -> DataFrame:
    """(a, b, far, ida, idb): of each pair of groups the two nearest points (g, id, x), if they are within reach; of equally near ones
    those with the smaller ids. With settle a pair is only (a, b), and done as soon as a bound says that it is within reach.

    Boxes around the points of a group are split in 4^d wherever their bounds leave a pair open, until few points are left (64 distances
    a pair of boxes, or few in all).
    """
    points = checkpointed(points)
    found = points.sparkSession.createDataFrame([], "a long, b long, far double, ida long, idb long")
    named = lambda df, s, keys: df.select(*(F.col(k).alias(s if k == "g" else f"{s}{k}") for k in keys), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"), F.col("n").alias(f"{s}_n"))
    empty = F.array().cast("array<bigint>")
    whole = _boxes(points.withColumn("_s", empty), ["g", "_s"], d)
    open_ = pairs.select("a", "b").distinct().join(named(whole, "a", ["g", "_s"]), "a").join(named(whole, "b", ["g", "_s"]), "b")
    for level in range(60):
        open_ = checkpointed(open_.withColumns(_bounds(d)).where(F.col("least") <= within * MORE))
        best = open_.groupBy("a", "b").agg(F.min("most").alias("best"))
        if settle:
            sure = best.where(F.col("best") * MORE <= within)
            done = checkpointed(sure.select("a", "b", F.col("best").alias("far"), F.lit(None).cast("long").alias("ida"), F.lit(None).cast("long").alias("idb")))
            found, open_ = found.union(done), open_.join(done.select("a", "b"), ["a", "b"], "left_anti")
        open_ = checkpointed(open_.join(best, ["a", "b"]).where(F.col("least") <= F.col("best") * MORE).drop("best", "least", "most"))
        n, work = open_.agg(F.count("*"), F.sum(F.col("a_n").cast("double") * F.col("b_n"))).first()
        if not n:
            return found
        here = points.withColumn("_s", empty if not level else _cell(side / 4 ** (level - 1)))
        used = open_.select(F.col("a").alias("g"), F.col("a_s").alias("_s")).union(open_.select("b", "b_s")).distinct()
        here = here.join(used, ["g", "_s"], "left_semi")
        if work <= max(64 * n, ENOUGH) or level == 59:
            one = lambda s: here.select(F.col("g").alias(s), F.col("_s").alias(f"{s}_s"), F.col("id").alias(f"id{s}"), F.col("x").alias(f"x{s}"))
            met = open_.select("a", "b", "a_s", "b_s").join(one("a"), ["a", "a_s"]).join(one("b"), ["b", "b_s"]).withColumn("far", _far(F.col("xa"), F.col("xb"))).where(F.col("far") <= within)
            return found.union(met.groupBy("a", "b").agg(F.min(F.struct("far", "ida", "idb")).alias("m")).select("a", "b", "m.*"))
        parts = checkpointed(_boxes(here.withColumn("_t", _cell(side / 4**level)), ["g", "_s", "_t"], d))
        split = lambda s: named(parts, s, ["g", "_s", "_t"])
        open_ = open_.select("a", "b", "a_s", "b_s").join(split("a"), ["a", "a_s"]).join(split("b"), ["b", "b_s"]).drop("a_s", "b_s").withColumnsRenamed({"a_t": "a_s", "b_t": "b_s"})
    raise AssertionError


def _near(probes: DataFrame, blocks: DataFrame, cells: DataFrame, steps: Column, eps: float, d: int) -> DataFrame:
    """(id, cell, n): how many points of the blocks of each cell around lie within eps of a probe (id, x, cell)."""
    asked = probes.groupBy("cell").agg(F.collect_list(F.struct("id", "x")).alias("s"))
    asked = asked.select(F.col("s.id").alias("ids"), F.flatten("s.x").alias("xs"), F.explode(steps).alias("step"), "cell").withColumn("cell", _moved("cell", "step")).drop("step")
    asked = asked.join(cells.select("cell", "chunks"), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, xs, ys, cell in zip(b["ids"], b["xs"], b["ys"], b["cell"], strict=True):
                x, y = np.reshape(xs, (-1, d)), np.reshape(ys, (-1, d))
                n = np.array([(np.sqrt(((y - v) ** 2).sum(1)) <= eps).sum() for v in x])
                on = np.flatnonzero(n)
                if len(on):
                    yield pd.DataFrame({"id": np.asarray(ids)[on], "cell": [cell] * len(on), "n": n[on]})

    return asked.join(blocks, ["cell", "chunk"]).select("ids", "xs", "ys", "cell").mapInPandas(counted, "id long, cell array<long>, n long")


def dbscan(df: DataFrame, key: str, features: list[str], eps: float, min_points: int) -> DataFrame:
    """(id, cluster, core): clusters by density, named by their smallest core row; null is noise. A core row has min_points rows within
    eps, itself included; core rows within eps of each other are of one cluster, and another row is of the first-named cluster
    that has a core row within eps of it.

    Cells have a diagonal of eps: one with min_points rows holds core rows only, without any pair, and the core rows of a cell
    are of one cluster. Other cells have few rows, which are held against the cells around, block by block; cells
    with core rows are connected by their closest pair.
    """
    d = len(features)
    side = eps / d**0.5 / MORE
    steps = _around(d, side, eps)
    points = checkpointed(_points(df, key, features).withColumn("cell", _cell(side)))
    cells = checkpointed(points.groupBy("cell").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / BLOCK)))
    placed = scans.beside_value(points, cells, ["cell"], F.struct("n", "chunks"), "__c")
    placed = checkpointed(placed.select("id", "x", "cell", F.col("__c.n").alias("n"), F.pmod(F.xxhash64("id"), F.col("__c.chunks")).alias("chunk")))
    few = placed.where(F.col("n") < min_points)
    blocks = lambda rows: rows.groupBy("cell", "chunk").agg(F.flatten(F.collect_list("x")).alias("ys"))
    counted = _near(few, blocks(placed), cells, steps, eps, d).groupBy("id").agg(F.sum("n").alias("near")).where(F.col("near") >= min_points)
    sparse = checkpointed(few.join(counted.select("id", F.lit(True).alias("core")), "id", "left").withColumn("core", F.coalesce("core", F.lit(False))))
    dense = placed.where(F.col("n") >= min_points).withColumn("core", F.lit(True))
    core = checkpointed(dense.unionByName(sparse.where("core")).select("id", "x", "cell", "chunk"))

    named = checkpointed(core.groupBy("cell").agg(F.min("id").alias("g"), F.count("*").alias("n")))
    pairs = named.select(F.col("g").alias("a"), "cell", F.explode(steps).alias("step")).select("a", _moved("cell", "step").alias("cell")).join(named.select("cell", F.col("g").alias("b")), "cell").where("a < b")
    groups = scans.beside_value(core.select("id", "x", "cell"), named, ["cell"], F.col("g"), "g")
    edges = closest(groups.select("g", "id", "x"), pairs, d, side, eps, settle=True)
    joined = graphs.connected_components(edges.select("a", "b"))
    clusters = checkpointed(named.join(joined.withColumnRenamed("node", "g"), "g", "left").select("cell", "n", F.coalesce("component", "g").alias("cluster")))

    inner = scans.beside_value(core.select("id", "cell"), clusters, ["cell"], F.col("cluster"), "cluster").select("id", "cluster", F.lit(True).alias("core"))
    rest = sparse.where("not core")
    met = _near(rest, blocks(core), cells, steps, eps, d).select("id", "cell").join(clusters, "cell").groupBy("id").agg(F.min("cluster").alias("cluster"))
    return inner.unionByName(rest.select("id").join(met, "id", "left").select("id", "cluster", F.lit(False).alias("core")))


def _forest(edges: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """The (a, b) of the lightest forest, and (comp, component) of its nodes. Up to `few` edges are looked at here, without jobs."""
    if edges.count() > few:
        tree = checkpointed(graphs.spanning_forest(edges).select("a", "b"))
        return tree, graphs.connected_components(tree).withColumnRenamed("node", "comp")
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y] = up.get(y, y)
            x = up[x]
        return x

    tree = []
    for w, a, b in sorted((r["w"], r["a"], r["b"]) for r in edges.collect()):
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            tree.append((a, b))
    spark = edges.sparkSession
    return spark.createDataFrame(tree, "a long, b long"), spark.createDataFrame([(x, root(x)) for x in list(up)], "comp long, component long")


def linkage(df: DataFrame, key: str, features: list[str], few: int = 100_000) -> DataFrame:
    """(a, b, w): the joins of single linkage, one fewer than there are rows: the lightest edges that connect all rows. Of equally
    long ones any set that connects them.

    Rows in one place are joined first. Then by rounds of a radius that grows fourfold: rows nearer than the radius
    before are one cluster by now, so a cell meets few clusters, and each two clusters of cells around are joined by their closest
    pair. The lightest of these, by Boruvka's rounds, are the joins up to this radius.
    """
    d = len(features)
    rows = checkpointed(_points(df, key, features))
    places = checkpointed(rows.groupBy("x").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    same = scans.beside_value(rows, places, ["x"], F.col("first"), "first").where("id <> first")
    made = [checkpointed(same.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w")))]
    points = checkpointed(places.select(F.col("first").alias("id"), "x", F.col("first").alias("comp")))
    ends = points.select(*(F.max(F.col("x")[i]) - F.min(F.col("x")[i]) for i in range(d)), F.count("*")).first()
    widest, left = max((v or 0.0 for v in ends[:d]), default=0.0), ends[d]
    reach = widest
    while left > 1 and points.groupBy(_cell(reach)).count().agg(F.max("count")).first()[0] > 16:
        reach /= 8
    while left > 1:
        cells = points.select("id", "x", "comp", _cell(reach).alias("cell"))
        groups = checkpointed(cells.groupBy("comp", "cell").agg(F.min("id").alias("g"), F.count("*").alias("n")))
        around = groups.select(F.col("g").alias("a"), F.col("comp").alias("ca"), "cell", F.explode(_around(d, reach, reach)).alias("step"))
        pairs = around.select("a", "ca", _moved("cell", "step").alias("cell")).join(groups.select("cell", F.col("g").alias("b"), F.col("comp").alias("cb")), "cell").where("ca < cb")
        pairs = checkpointed(pairs.select("a", "b", "ca", "cb"))
        placed = scans.beside_value(cells, groups, ["comp", "cell"], F.col("g"), "g")
        near = closest(placed.select("g", "id", "x"), pairs, d, reach, reach, settle=False).join(pairs, ["a", "b"])
        near = checkpointed(near.groupBy("ca", "cb").agg(F.min(F.struct("far", "ida", "idb")).alias("m")).select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("m.far").alias("w"), "m.ida", "m.idb"))
        tree, roots = _forest(near.select("a", "b", "w"), few)
        joins = checkpointed(near.join(tree, ["a", "b"]))
        made.append(joins.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"), "w"))
        sizes = points.groupBy("comp").agg(F.count("*").alias("n")).join(roots, "comp", "left")
        sizes = checkpointed(sizes.select("comp", "n", F.coalesce("component", "comp").alias("root")))
        points = checkpointed(scans.beside_value(points, sizes, ["comp"], F.col("root"), "root").select("id", "x", F.col("root").alias("comp")))
        left, reach = sizes.select("root").distinct().count(), reach * 4
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def agglomerative(df: DataFrame, key: str, features: list[str], clusters: int | None = None, distance: float | None = None) -> DataFrame:
    """(id, cluster) by single linkage, cut to so many clusters, or where joins are longer than a distance; a cluster is named by its
    smallest row. Of equally long joins those of the larger rows are cut first.

    What joins of up to a distance connect is what lies within that distance step by step: along few columns, rows are
    connected over a grid, without the joins."""
    if distance is not None and 0 < distance < float("inf") and len(features) <= GRID:
        return dbscan(df, key, features, distance, 1).select("id", "cluster")
    joins = linkage(df, key, features)
    if distance is not None:
        kept = joins.where(F.col("w") <= distance)
    else:
        joins = checkpointed(joins)
        gone = joins.orderBy(F.desc("w"), F.desc("a"), F.desc("b")).limit(clusters - 1)
        kept = joins.join(F.broadcast(gone), ["a", "b"], "left_anti")
    named = graphs.connected_components(kept.select("a", "b"))
    return _points(df, key, features).select("id").join(named.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
