"""Centroid clustering by Exponion search.

Components become integers, so distances and centroids are exact. Every vector keeps its centroid a, an upper bound u of its
distance to it and a lower bound l of its distance to the second nearest. When centroids move, u grows by its centroid's way
and l shrinks by the longest way. A vector with u below l, or below half the way from a to the nearest other centroid, stays
without a look at any centroid. For the others u is made exact, and if that doesn't settle it, only centroids within
2u + (a's way to its nearest other centroid) of a can be nearest or second nearest: they are the first so many of a's sorted list
of centroids. All comparisons that skip are strict and the ball includes its rim, so equal distances are seen, and go to the
centroid with the smaller number.

Vectors pass through each round in Arrow blocks with their bounds; centroids, of which there are k, are sent with the function;
the sums of each centroid's vectors are added up in the tasks before they are shuffled. Each round is written to the shared
folder, and the one before is removed by Spark once nothing refers to it.

What happens in each case: vectors that are null, of another length, or with a null or non-finite component take no part, nor
do those with a component whose integer lies beyond 2^27 either way, as their squared distances may not fit a long; repeated rows
each count; vectors of one id, or none, that compete as first centroids are taken by their components; fewer
vectors than k: as many centroids; an empty table: an empty result; an inertia that doesn't fit a long is null; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, workers_can_import

#: Whole numbers that doubles hold exactly.
EXACT = float(1 << 53)
#: Squared distances of components within this fit a long.
LIMIT = 1 << 27
#: Room for rounding in bounds, which are doubles.
LESS, MORE = 1 - 1e-12, 1 + 1e-12


def integer_vectors(rows: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    size = lambda x: F.abs(x.cast("double")) * scale
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"))
    kept = kept.where((F.size("x") == dim) & F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (size(x) < LIMIT), F.lit(False))))
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose `1:<id>` has the smallest SHA-256."""
    chance = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in vectors.orderBy(chance.asc_nulls_last(), "v").limit(k).collect()], dtype=np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all v to all c."""
    if float(abs(v).max(initial=0) + abs(c).max(initial=0)) ** 2 * v.shape[1] < EXACT:
        v, c = v.astype(float), c.astype(float)
        return np.rint((v**2).sum(1)[:, None] - 2 * (v @ c.T) + (c**2).sum(1)[None]).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(1) for x in c], axis=1)


class Search:
    """The centroids of a round, and the ways of each from those of the round before. `looks` counts distances computed."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c, self.looks = centroids, 0
        apart = np.sqrt(squared(centroids, centroids).astype(float))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        for j, near in enumerate(self.order):  # itself first, also where other centroids lie on it
            at = int(np.flatnonzero(near == j)[0])
            near[1 : at + 1] = near[:at].copy()
            near[0] = j
        self.nearest = self.apart[:, 1] if len(centroids) > 1 else np.full(len(centroids), np.inf)
        self.ways = np.zeros(len(centroids)) if before is None else np.sqrt(np.array([((a - b) ** 2).sum() for a, b in zip(centroids, before, strict=True)], dtype=float)) * MORE

    def _best(self, v: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest, upper, lower) among some centroids; smaller numbers win ties."""
        among = np.sort(among)
        far = squared(v, self.c[among])
        self.looks += far.size
        at = far.argmin(1)
        best = far[np.arange(len(v)), at]
        second = np.inf
        if len(among) > 1:
            far[np.arange(len(v)), at] = np.iinfo(np.int64).max
            second = np.sqrt(far.min(1).astype(float)) * LESS
        return among[at], np.sqrt(best.astype(float)) * MORE, np.broadcast_to(second, len(v))

    def start(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, u, low = self._best(v, np.arange(len(self.c)))
        return a, u, low.copy()

    def move(self, v: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next (a, u, l), from those for the centroids before."""
        u, low = (u + self.ways[a]) * MORE, (low - self.ways.max(initial=0)) * LESS
        safe = np.maximum(low, self.nearest[a] / 2 * LESS)
        open_ = np.flatnonzero(u >= safe)
        exact = ((v[open_] - self.c[a[open_]]) ** 2).sum(1)
        self.looks += len(open_)
        u[open_] = np.sqrt(exact.astype(float)) * MORE
        open_ = open_[u[open_] >= safe[open_]]
        # Vectors of one centroid whose balls hold as many of its list are looked at together.
        was = a[open_]
        balls = (2 * u[open_] + self.nearest[was]) * MORE
        held = np.array([np.searchsorted(self.apart[c], r, side="right") for c, r in zip(was, balls, strict=True)], dtype=np.int64)
        for c, n in np.unique(np.stack([was, held], axis=1), axis=0):
            rows = open_[(was == c) & (held == n)]
            a[rows], u[rows], low[rows] = self._best(v[rows], self.order[c][:n])
        return a, u, low


SCHEMA = "vec_id long, v array<int>, a int, u double, l double"


def _assigned(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None, dim: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, before)
        for b in batches:
            v = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
            if before is None:
                a, u, low = search.start(v)
            else:
                a, u, low = search.move(v, *(b[x].to_numpy(zero_copy_only=False).copy() for x in "aul"))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(a.astype(np.int32)), pa.array(u), pa.array(low.astype(float))], names=["vec_id", "v", "a", "u", "l"])

    return rows.mapInArrow(of, SCHEMA)


def _next(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' mean, rounded down; one without any stays."""
    sums = rows.groupBy("a").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])))
    made = centroids.copy()
    for r in sums.collect():  # one row a centroid
        made[r["a"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return made


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector after so many rounds."""
    spark = rows.sparkSession
    workers_can_import(spark)
    vectors = integer_vectors(rows, dim, scale, id_col, vector_col)
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    before, now = None, vectors
    for _ in range(rounds):
        now = cut(_assigned(now, centroids, before, dim))
        before, centroids = centroids, _next(now, centroids)
    now = _assigned(now, centroids, before, dim)
    ends = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(centroids)], "a int, c array<long>")
    distance = F.aggregate(F.zip_with("v", "c", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)
    found = cut(now.join(F.broadcast(ends), "a").select("vec_id", F.col("a").alias("cluster"), distance.alias("distance")))
    of = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    total = of.agg(F.sum("s").alias("t"))
    digest = F.sha2(F.array_join(F.col("c").cast("array<string>"), ","), 256).alias("centroid_sha256")
    told = of.join(F.broadcast(total)).join(F.broadcast(ends), F.col("cluster") == F.col("a")).select("cluster", F.col("s").try_cast("long").alias("cluster_inertia"), F.col("t").try_cast("long").alias("inertia"), digest)
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
