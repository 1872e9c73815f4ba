"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's components are dealt to a few segments; a segment's score of a query and a candidate is its part of the
inner product, which the product of the two segments' lengths bounds from above before it is computed.

1. Each block of candidates computes one segment's scores only, the next block another's, and gives, for each query, the
   candidates that lead this list, with their whole scores. The k-th highest score found this way over all blocks is a
   safe cutoff: the true k-th score can't be lower.
2. The cutoff goes back to the blocks. What reaches it must have a bound of at least cutoff / segments in some segment, and
   bounds of at least the cutoff in all; other candidates go without any product. For the rest segments are
   computed one after another, the ones that decide most first, and after each the candidates go whose computed parts and
   remaining bounds together are below the cutoff, or below the k-th score met meanwhile.
3. The candidates left after the last segment have their exact score, and each query's k highest are taken.

Queries and candidates are both cut into blocks of bounded size, and each pair of blocks is one group of a cogroup. So
memory is bounded whatever their number, and all rows of a set of queries are held against all vectors, in blocks.

What happens in each case: null vectors, vectors with null or non-finite components, and rows with a null id take no
part, nor do vectors of n components with one whose integer lies beyond sqrt(2^62 / n), as their scores may not fit a long; candidates of another length than the query's aren't its candidates; a query is no candidate of its own, and
neither is a repeated row with its id; other rows are candidates each for itself, repeated or not; a query row that
repeats id and vector asks once, and rows of one id with different vectors share that query's ranks; fewer than k candidates: all of them; ties go to the smaller id; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import cut, workers_can_import

#: Products below this are exact as doubles.
EXACT = float(1 << 53)
#: Scores up to this fit a long.
LARGEST = float(1 << 62)
#: Queries and candidates that are held against each other at a time.
TILE = (256, 4096)
#: Share of a tile's pairs that must be left for a segment to be computed for the whole tile.
DENSE = 0.25


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, n, v) with v as longs: floor(scale * component); of the rows that take part."""
    real = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), real.alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall("v", fine) & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: F.abs(x * scale) < F.sqrt(LARGEST / F.size("v"))))
    return rows.select("id", F.size("v").alias("n"), F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def _lengths(v: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The length of each vector's segments, rounded up."""
    return np.stack([np.sqrt((v[:, s].astype(float) ** 2).sum(1)) for s in cuts], axis=1) * (1 + 1e-9) + 1e-6


class Block:
    """A block of queries against a block of candidates. `products` counts the multiplications of components."""

    def __init__(self, q_ids: np.ndarray, qs: np.ndarray, ids: np.ndarray, cs: np.ndarray, k: int, segments: int):
        self.q_ids, self.ids, self.k, self.products = q_ids, ids, k, 0
        exact = float(abs(qs).max()) * float(abs(cs).max()) * qs.shape[1] < EXACT
        self.qs, self.cs = (qs.astype(float), cs.astype(float)) if exact else (qs, cs)
        self.cuts = np.array_split(np.arange(qs.shape[1]), min(segments, qs.shape[1]))

    def _tiles(self):
        for a in range(0, len(self.q_ids), TILE[0]):
            for b in range(0, len(self.ids), TILE[1]):
                yield slice(a, a + TILE[0]), slice(b, b + TILE[1])

    def _pairs(self, at: np.ndarray, who: np.ndarray, columns: np.ndarray | slice) -> np.ndarray:
        """The products of some pairs, over some components."""
        out = np.empty(len(at), self.qs.dtype)
        for x in range(0, len(at), 1 << 16):
            i, j = at[x : x + (1 << 16)], who[x : x + (1 << 16)]
            out[x : x + (1 << 16)] = np.einsum("ij,ij->i", self.qs[i][:, columns], self.cs[j][:, columns])
        self.products += len(at) * (self.qs.shape[1] if isinstance(columns, slice) else len(columns))
        return out

    def _best(self, at: np.ndarray, who: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query among these pairs."""
        order = np.lexsort((self.ids[who], -score, at))
        at, who, score = at[order], who[order], score[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        kept = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) < self.k
        return at[kept], who[kept], score[kept]

    def leaders(self, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, whole score) of those that lead one segment's list."""
        cut, found = self.cuts[segment % len(self.cuts)], []
        for a, b in self._tiles():
            part = (self.qs[a][:, cut] @ self.cs[b][:, cut].T).astype(float)
            self.products += part.size * len(cut)
            part[self.q_ids[a][:, None] == self.ids[b][None]] = -np.inf
            lead = np.argpartition(-part, min(self.k, part.shape[1]) - 1, axis=1)[:, : self.k]
            rows = np.repeat(np.arange(len(part)), lead.shape[1])
            real = np.isfinite(part[rows, lead.ravel()])
            at, who = rows[real] + a.start, lead.ravel()[real] + b.start
            found.append((at, who, self._pairs(at, who, slice(None))))
        return self._best(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def reaching(self, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, whole score) of the k best of each query that reach its cutoff."""
        q_len, c_len = _lengths(self.qs, self.cuts), _lengths(self.cs, self.cuts)
        order = np.argsort(-(q_len**2).mean(0) * (c_len**2).mean(0))
        best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, self.qs.dtype))
        cutoff = cutoff.astype(float)
        for a, b in self._tiles():
            bound = q_len[a] @ c_len[b].T
            limit = cutoff[a][:, None] - 1e-9 * bound.max(initial=0)  # what adding and taking away may round off
            alive = (bound >= limit) & (self.q_ids[a][:, None] != self.ids[b][None])
            total, pairs = np.zeros(bound.shape, self.qs.dtype), None
            for s in order:
                if pairs is None and alive.mean() >= DENSE:
                    cut = self.cuts[s]
                    part = self.qs[a][:, cut] @ self.cs[b][:, cut].T
                    self.products += part.size * len(cut)
                    total += part
                    bound += part - q_len[a, s][:, None] * c_len[b, s][None]
                    alive &= bound >= limit
                    continue
                if pairs is None:
                    at, who = np.nonzero(alive)
                    pairs = [at, who, total[at, who], bound[at, who]]
                at, who, sums, bounds = pairs
                part = self._pairs(at + a.start, who + b.start, self.cuts[s])
                sums, bounds = sums + part, bounds + part - q_len[at + a.start, s] * c_len[who + b.start, s]
                on = bounds >= limit[at, 0]
                pairs = [at[on], who[on], sums[on], bounds[on]]
            if pairs is None:
                at, who = np.nonzero(alive)
                pairs = [at, who, total[at, who]]
            at, who, sums = pairs[0] + a.start, pairs[1] + b.start, pairs[2]
            on = sums >= cutoff[at]
            best = self._best(*(np.concatenate(x) for x in zip(best, (at[on], who[on], sums[on]), strict=True)))
            # A query's k-th score so far is a cutoff too; equal scores stay, for the smaller id.
            last = np.flatnonzero(np.diff(best[0], append=-1))
            full = last[np.bincount(best[0], minlength=len(cutoff))[best[0][last]] >= self.k]
            cutoff[best[0][full]] = np.maximum(cutoff[best[0][full]], best[2][full].astype(float))
        return best


def _of_blocks(f, k: int, segments: int):
    """f(block, queries, candidates) in a pair of blocks, as a frame of (query_id, vec_id, score)."""
    matrix = lambda v: np.stack(v.to_numpy()).astype(np.int64)

    def of(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({x: np.zeros(0, np.int64) for x in ("query_id", "vec_id", "score")})
        block = Block(q["id"].to_numpy(), matrix(q["v"]), c["id"].to_numpy(), matrix(c["v"]), k, segments)
        at, who, score = f(block, q, c)
        return pd.DataFrame({"query_id": block.q_ids[at], "vec_id": block.ids[who], "score": score.astype(np.int64)})

    return of


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, segments: int = 8, block: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row where is_query holds (a
    condition on the column `id`) with all others."""
    spark = vectors.sparkSession
    workers_can_import(spark)
    rows = cut(integer_vectors(vectors, id_col, vector_col, scale))
    queries = rows.where(is_query).dropDuplicates(["id", "v"])
    n, m = rows.count(), queries.count()
    cells = max(1, -(-n // block), min(spark.sparkContext.defaultParallelism, -(-n // 1024)))
    parts = max(1, -(-m // block))
    spread = lambda seed, to: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(to)).cast("int")
    every = lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)))
    candidates = rows.select("*", spread(1, cells).alias("cell"), every(parts).alias("part")).groupBy("n", "cell", "part")
    asked = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns)).toDF(*queries.columns).withColumn("part", spread(2, parts))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    schema = "query_id long, vec_id long, score long"

    def phase(asking: DataFrame, f) -> DataFrame:
        return asking.withColumn("cell", every(cells)).groupBy("n", "cell", "part").cogroup(candidates).applyInPandas(f, schema)

    leads = phase(asked, _of_blocks(lambda block, q, c: block.leaders(int(c["cell"].iloc[0])), k, segments))
    cutoffs = cut(leads.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cutoff")))
    found = phase(asked.join(cutoffs, "id", "left"), _of_blocks(lambda block, q, c: block.reaching(q["cutoff"].astype(float).fillna(-np.inf).to_numpy()), k, segments))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
