"""Products of large matrices, as tables of entries (i, j, v); entries that are missing are 0, null ones are missing.

Where entries are thin, each meets the entries of its inner index by a join, and the products of a row are added up where the row
is. Indices with many products, and rows with many entries, are cut into shares.

Otherwise entries are gathered into blocks of SIDE x SIDE. Blocks that share their inner index meet by a join, whose keys hold at most
SHARE blocks of either side, whatever the shapes; numpy multiplies them in the tasks, and the partial products of a place are
added up 16 at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.running import checkpointed, numbered

SIDE = 256
#: Blocks of one side that a key of the join holds at most.
SHARE = 32
#: Entries are thin if blocks would have fewer products of entries than this for each pair of blocks.
THIN = 2048
#: Products of an inner index, and entries of a row, that a share holds about.
PRODUCTS = 1 << 22
ENTRIES = 1 << 16


def entries(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A frame's columns as a matrix: rows by the order, columns as listed, both from 0."""
    rows = numbered(df, order, "i")
    cells = F.array(*(F.struct(F.lit(k).cast("long").alias("j"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)))
    return rows.select("i", F.explode(cells).alias("c")).select("i", "c.j", "c.v").where("v is not null")


def transposed(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _blocks(m: DataFrame) -> DataFrame:
    """(bi, bj, at, vs): each block's entries, by their place in it; entries of one place are added up."""
    rows = m.where("v is not null").groupBy("i", "j").agg(F.sum("v").alias("v"))
    place = F.pmod("i", F.lit(SIDE)) * SIDE + F.pmod("j", F.lit(SIDE))
    cells = rows.select(F.expr(f"(i - pmod(i, {SIDE})) div {SIDE}").alias("bi"), F.expr(f"(j - pmod(j, {SIDE})) div {SIDE}").alias("bj"), F.struct(place.cast("int").alias("at"), F.col("v").cast("double").alias("v")).alias("e"))
    return cells.groupBy("bi", "bj").agg(F.collect_list("e").alias("e")).select("bi", "bj", F.col("e.at").alias("at"), F.col("e.v").alias("vs"))


def _places(blocks: DataFrame) -> DataFrame:
    """(i, j, v) of the entries of blocks."""
    cells = blocks.select("bi", "bj", F.explode(F.arrays_zip("at", "vs")).alias("c"))
    return cells.select((F.col("bi") * SIDE + F.expr(f"c.at div {SIDE}")).alias("i"), (F.col("bj") * SIDE + F.col("c.at") % SIDE).alias("j"), F.col("c.vs").alias("v"))


def _dense(at: np.ndarray, vs: np.ndarray) -> np.ndarray:
    out = np.zeros(SIDE * SIDE)
    out[np.asarray(at)] = vs
    return out.reshape(SIDE, SIDE)


def _row(bi: int, bj: int, part: int, block: np.ndarray) -> pd.DataFrame:
    at = np.flatnonzero(block)
    return pd.DataFrame({"bi": [bi], "bj": [bj], "part": [part], "at": [at.astype(np.int32)], "vs": [block.ravel()[at]]})


def _multiplied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for r in b.itertuples():
            yield _row(r.bi, r.bj, r.k, _dense(r.at, r.vs) @ _dense(r.at2, r.vs2))


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    first = rows.iloc[0]
    return _row(first["bi"], first["bj"], first["part"] // 16, sum(_dense(at, vs) for at, vs in zip(rows["at"], rows["vs"], strict=True)))


_PARTS = "bi long, bj long, part long, at array<int>, vs array<double>"


def _is_thin(left: DataFrame, right: DataFrame) -> bool:
    """Whether blocks would have few products of entries, taken as evenly spread over the inner indices, for each pair of blocks."""
    of = lambda m, k, n: m.groupBy(F.col(k).alias("k")).agg(F.count("*").cast("double").alias(f"{n}b"), F.sum(F.size("at")).cast("double").alias(n))
    products, pairs = of(left, "bj", "l").join(of(right, "bi", "r"), "k").agg(F.sum(F.col("l") * F.col("r") / SIDE), F.sum(F.col("lb") * F.col("rb"))).first()
    return (products or 0.0) <= THIN * (pairs or 0.0)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of products (i, v, js, vs) by place; rows come by i."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    out = lambda cells: pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["i", "j", "v"])
    for b in batches:
        if not b.num_rows:
            continue
        n = np.diff(b.column("js").offsets.to_numpy())
        each = lambda c, b=b, n=n: np.repeat(b.column(c).to_numpy(), n)
        of = lambda c, b=b: b.column(c).flatten().to_numpy()
        i, j, v = (np.concatenate([h, x]) for h, x in zip(held, (each("i"), of("js"), each("v") * of("vs")), strict=True))
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        cells = [i[first], j[first], np.add.reduceat(v[order], first)]
        done = int(np.searchsorted(cells[0], cells[0][-1]))
        held = [c[done:] for c in cells]
        if done:
            yield out([c[:done] for c in cells])
    if len(held[0]):
        yield out(held)


def _thin(left: DataFrame, right: DataFrame) -> DataFrame:
    """The product of (i, k, v) and (k, j, v), pair by pair."""
    of = lambda m, n: m.groupBy("k").agg(F.count("*").cast("double").alias(n))
    counts = of(left, "a").join(of(right, "b"), "k").select("k", (F.col("a") * F.col("b")).alias("w"))
    many = lambda m, c, most: m.groupBy(c).agg(F.count("*").alias("n")).where(F.col("n") > most).select(c, F.ceil(F.col("n") / most).cast("long"))
    share = lambda of, n: F.pmod(F.xxhash64(of), F.coalesce(n, F.lit(1).cast("long")))
    hot = F.broadcast(checkpointed(counts.where(F.col("w") > PRODUCTS).select("k", F.ceil(F.col("w") / PRODUCTS).cast("long").alias("__s"))))
    wide = checkpointed(many(left, "i", ENTRIES).toDF("i", "__t"))
    long_ = F.broadcast(checkpointed(many(right, "k", SIDE).toDF("k", "__c")))
    l_ = left.join(hot, "k", "left").join(F.broadcast(wide), "i", "left").select("i", "k", "v", share("k", F.col("__t")).alias("part"), share("i", F.col("__s")).alias("x"))
    parts = right.join(long_, "k", "left").groupBy("k", share("j", F.col("__c")).alias("c")).agg(F.collect_list(F.struct("j", "v")).alias("r"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__s", F.lit(1).cast("long")) - 1))
    r_ = parts.join(hot, "k", "left").select("k", F.col("r.j").alias("js"), F.col("r.v").alias("vs"), every.alias("x"))
    met = l_.join(r_, ["k", "x"]).select("i", "part", "v", "js", "vs").repartition("i", "part").sortWithinPartitions("i")
    made = met.select("i", "v", "js", "vs").mapInArrow(_summed, "i long, j long, v double")
    return (made if wide.isEmpty() else made.groupBy("i", "j").agg(F.sum("v").alias("v"))).where("v <> 0")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the matrix product; what is 0 is left out."""
    left, right = checkpointed(_blocks(a)), checkpointed(_blocks(b))
    if _is_thin(left, right):
        return _thin(_places(left).withColumnRenamed("j", "k"), _places(right).withColumnRenamed("i", "k"))
    wide = lambda m, k: F.greatest(F.lit(1), F.ceil(F.lit((m.groupBy(k).count().agg(F.max("count")).first()[0] or 0) / SHARE))).cast("int")
    rows, columns = wide(left, "bj"), wide(right, "bi")  # shares in which one inner index's blocks are cut
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    l_ = left.select("bi", F.col("bj").alias("k"), "at", "vs", F.pmod(F.xxhash64("bi"), rows).cast("int").alias("x")).withColumn("y", every(columns))
    r_ = right.select(F.col("bi").alias("k"), "bj", F.col("at").alias("at2"), F.col("vs").alias("vs2"), F.pmod(F.xxhash64("bj"), columns).cast("int").alias("y")).withColumn("x", every(rows))
    parts = checkpointed(l_.join(r_, ["k", "x", "y"]).select("bi", "bj", "k", "at", "vs", "at2", "vs2").mapInPandas(_multiplied, _PARTS))
    inner = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.groupBy("bi", "bj", F.expr("part div 16")).applyInPandas(_added, _PARTS)
        inner = -(-inner // 16)
        if inner <= 1:
            return _places(parts)
