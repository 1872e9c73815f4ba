"""Nearest rows by distance: a stated set of queries against all rows, and what follows from it.

Rows in one place are one, with as many of their smallest keys as can be among the nearest. Along few columns a tree cuts the space into leaves
of about LEAF places; a query looks into its own leaf first, and then into those whose box is no further than what it found.
Its cuts come from a bounded sample, which decides how even the leaves are and nothing else. Along many columns boxes spare nothing, and
all places are one leaf. Within a leaf blocks of queries meet blocks of places, in shares of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import scans
from gridloom.operators.running import checkpointed

#: Queries, and places, in a block: a task holds one block of either at a time.
BLOCK = 1024
#: Blocks of either side that a share of a leaf holds.
SHARE = 16
#: Places that a leaf is to have, the most leaves, sampled places for each, and columns up to which there is more than one leaf.
LEAF, LEAVES, SAMPLED, FEW = 512, 4096, 16, 8
#: Room for rounding in bounds.
MORE = 1 + 1e-9


def _vectors(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(id, v) of the rows that take part."""
    some = df.select(F.col(key).alias("id"), F.array(*(F.col(c).cast("double") for c in features)).alias("v"))
    return some.where(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


class _Tree:
    """Cuts of the space: node i goes on in 2 i, or in 2 i + 1 beyond its cut."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.axis, self.cut = depth, np.zeros(1 << depth, int), np.zeros(1 << depth)
        parts = {1: sample}
        for i in range(1, 1 << depth):
            x = parts.pop(i)
            if len(x):
                self.axis[i] = np.ptp(x, axis=0).argmax()
                self.cut[i] = np.median(x[:, self.axis[i]])
            beyond = x[:, self.axis[i]] > self.cut[i]
            parts |= {2 * i: x[~beyond], 2 * i + 1: x[beyond]}

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), int)
        for _ in range(self.depth):
            at = 2 * at + (x[np.arange(len(x)), self.axis[at]] > self.cut[at])
        return at


def _dealt(df: DataFrame, tree: _Tree) -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=tree.leaf(np.stack(b["v"])))

    return df.mapInPandas(of, ", ".join(f"{n} {t}" for n, t in [*df.dtypes, ("leaf", "long")]))


def _packed(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(leaf, {name}, {name}_n, columns): the rows of each leaf in blocks of about BLOCK; and how many blocks it has."""
    sizes = checkpointed(df.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias(f"{name}_n")))  # a row a leaf
    dealt = df.join(F.broadcast(sizes), "leaf").withColumn(name, F.pmod(F.xxhash64("v"), F.col(f"{name}_n")))
    packed = dealt.groupBy("leaf", name, f"{name}_n").agg(F.collect_list(F.struct("v", *columns)).alias("__r"))
    return packed.select("leaf", name, f"{name}_n", F.flatten("__r.v").alias(f"{name}_v"), *(F.col(f"__r.{c}").alias(f"{name}_{c}") for c in columns))


def _least(rank: np.ndarray, *by: np.ndarray, most: int) -> np.ndarray:
    """The places of the first `most` of each rank by the columns, the last of which counts most."""
    order = np.lexsort((*by, rank))
    r = rank[order]
    start = np.searchsorted(r, r)
    return order[np.arange(len(r)) - start < most]


def _met(asked: DataFrame, held: DataFrame, d: int, most: int, kinds: tuple[str, str]) -> DataFrame:
    """(q, square, id): for each query (q, v, leaf) and block of places of its leaf the `most` nearest rows at most."""
    asks = _packed(asked, ["q"], "a")
    sizes = F.broadcast(checkpointed(asks.groupBy("leaf").agg(F.max("a_n").alias("a_n"))))
    blocks = F.broadcast(checkpointed(held.groupBy("leaf").agg(F.max("r_n").alias("r_n"))))
    shares = lambda c: F.ceil(F.col(c) / SHARE)
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), shares(c) - 1))
    left = asks.join(blocks, "leaf").select("leaf", "a_v", "a_q", F.pmod("a", shares("a_n")).alias("s"), every("r_n").alias("t"))
    right = held.join(sizes, "leaf").select("leaf", "r_v", "r_ids", F.pmod("r", shares("r_n")).alias("t"), every("a_n").alias("s"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for one in b.itertuples():
                x, z = np.reshape(one.a_v, (-1, d)), np.reshape(one.r_v, (-1, d))
                off = np.zeros((len(x), len(z)))
                with np.errstate(over="ignore"):
                    for c in range(d):
                        off += (x[:, None, c] - z[None, :, c]) ** 2
                end = np.partition(off, most - 1, axis=1)[:, most - 1] if len(z) > most else np.full(len(x), np.inf)
                q, r = np.nonzero((off <= end[:, None]) & np.isfinite(off))
                first = np.asarray([i[0] for i in one.r_ids])
                near = _least(q, first[r], off[q, r], most=most)
                q, r = q[near], r[near]
                n = np.fromiter((len(one.r_ids[i]) for i in r), int, len(r))
                ids = np.concatenate([one.r_ids[i] for i in r]) if len(r) else first[:0]
                q, square = np.repeat(q, n), np.repeat(off[q, r], n)
                near = _least(q, ids, square, most=most)
                yield pd.DataFrame({"q": np.asarray(one.a_q)[q[near]], "square": square[near], "id": ids[near]})

    met = left.join(right, ["leaf", "s", "t"]).select("a_v", "a_q", "r_v", "r_ids")
    return met.mapInPandas(of, f"q {kinds[0]}, square double, id {kinds[1]}")


def _first(found: DataFrame, by: str, most: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("square", "id"))).where(F.col("rank") <= most)


def nearest(queries: DataFrame, rows: DataFrame, key: str, features: list[str], k: int, skip_self: bool = True) -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest rows of each query by Euclidean distance, ties to the smaller key.

    Keys are unique. Rows or queries with an unknown feature take no part, nor do distances that aren't finite.
    """
    d, most = len(features), k + 1  # one more, as a query may be among its nearest rows
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    places = _vectors(rows, key, features).withColumn("at", first).where(F.col("at") <= most).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    places = checkpointed(places)
    asked = _vectors(queries, key, features)
    points = checkpointed(asked.groupBy("v").agg(F.min("id").alias("q"), F.count("*").alias("n")))
    leaves = min(LEAVES, -(-places.count() // max(LEAF, 4 * most))) if d <= FEW else 1
    depth = max(0, leaves - 1).bit_length()
    sample = places.orderBy(F.xxhash64("v"), "v").limit(SAMPLED << depth).collect() if depth else []
    tree = _Tree(np.reshape([r["v"] for r in sample], (-1, d)), depth)
    dealt = checkpointed(_dealt(places, tree))
    held, kinds = checkpointed(_packed(dealt, ["ids"], "r")), tuple(dict(df.dtypes)[key] for df in (queries, rows))
    homes = checkpointed(_dealt(points.select("q", "v"), tree))
    found = checkpointed(_met(homes, held, d, most, kinds))
    if depth:
        boxes = dealt.groupBy("leaf").agg(*(f(F.col("v")[i]) for f in (F.min, F.max) for i in range(d))).collect()
        names, ends = np.array([r[0] for r in boxes]), np.array([r[1:] for r in boxes], float).reshape(-1, 2, d)

        def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), 256):
                    part = b.iloc[at : at + 256]
                    x, least = np.stack(part["v"]), 0.0
                    for c in range(d):
                        least = least + np.maximum(0, np.maximum(ends[None, :, 0, c] - x[:, None, c], x[:, None, c] - ends[None, :, 1, c])) ** 2
                    own = names[None, :] == part["leaf"].to_numpy()[:, None]
                    i, to = np.nonzero((least <= part["reach"].to_numpy(float)[:, None] * MORE) & ~own)
                    yield pd.DataFrame({"q": part["q"].to_numpy()[i], "v": part["v"].to_numpy()[i], "leaf": names[to]})

        last = _first(found, "q", most).groupBy("q").agg(F.when(F.count("*") == most, F.max("square")).alias("reach"))
        asks = homes.join(last, "q", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        more = asks.mapInPandas(further, f"q {kinds[0]}, v array<double>, leaf long")
        found = found.unionByName(_met(checkpointed(more), held, d, most, kinds))
    near = _first(found, "q", most).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("square", "id"))).alias("near"))
    near = scans.beside_value(asked, points.join(near, "q"), ["v"], F.col("near"), "near")
    kept = F.filter("near", lambda x: x["id"] != F.col("id")) if skip_self else F.col("near")
    out = near.select(F.col("id").alias("query"), F.posexplode(F.slice(kept, 1, k)).alias("at", "x"))
    return out.select("query", F.col("x.id").alias("neighbour"), F.sqrt("x.square").alias("distance"), (F.col("at") + 1).alias("rank"))


def classify(found: DataFrame, rows: DataFrame, key: str, label: str) -> DataFrame:
    """(query, prediction): the commonest label among the neighbours, ties to the smaller label."""
    votes = found.join(rows.select(F.col(key).alias("neighbour"), F.col(label).alias("__l")), "neighbour").groupBy("query", "__l").agg(F.count("*").alias("n"))
    return votes.groupBy("query").agg(F.min_by("__l", F.struct(-F.col("n"), F.col("__l"))).alias("prediction"))


def regress(found: DataFrame, rows: DataFrame, key: str, target: str) -> DataFrame:
    """(query, prediction): the neighbours' mean."""
    return found.join(rows.select(F.col(key).alias("neighbour"), F.col(target).alias("__y")), "neighbour").groupBy("query").agg(F.avg("__y").alias("prediction"))


def density(df: DataFrame, c: str, points: list[float], width: float) -> DataFrame:
    """(x, density): a Gaussian kernel's estimate at the given points, one aggregate over the rows."""
    x = F.col(c).cast("double")
    made = [F.struct(F.lit(float(p)).alias("x"), F.avg(F.exp(-F.pow((x - float(p)) / width, F.lit(2)) / 2) / (width * (2 * np.pi) ** 0.5)).alias("density")) for p in points]
    return df.agg(F.array(*made).alias("s")).select(F.inline("s"))


def silverman(c: str) -> Column:
    """A kernel's width by the rule of thumb, as an aggregate."""
    return 1.06 * F.stddev_samp(c) * F.pow(F.count(c).cast("double"), F.lit(-0.2))
