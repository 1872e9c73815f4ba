"""SimHash near-duplicate groups, linked by a grid range-join on segment popcounts.

A fingerprint of 64 bits is cut into 32 segments of 2 bits, and each segment is replaced by its number of set bits
(0, 1 or 2). One differing bit moves one count by at most one, so the Manhattan distance of two such vectors never
exceeds the Hamming distance of the fingerprints: it is a lower bound, and a range-join on the vectors at radius 3
misses nothing. The vectors are joined on a grid: if the distance over all 32 axes is at most 3, it is at most 1 over
the first or the last 16 axes. So each distinct fingerprint asks, for either half, for the grid cells at distance 0
and 1 (33 at most), and meets there the fingerprints whose half lies in the cell; pairs within Manhattan distance 3 over
all axes are then verified by the exact number of differing bits.

What happens in each case:

* null text, empty text, or text without a word: fingerprint zero, linked like any other;
* fewer than three words: the fingerprint of the whole word sequence;
* repeated rows and equal texts: equal fingerprints; linking works on distinct fingerprints, so a group of copies of
  any size costs one row there;
* null doc_id: the row gets a fingerprint, and a component_id that is the smallest non-null id reachable (null if
  there is none);
* empty table: empty result; further columns of the input are ignored by `near_duplicates`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import blocks, cut, workers_can_import
from gridloom.operators.graphs import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Shingles hashed at a time, so that a very long text needs little memory.
BLOCK = 1 << 16
SEGMENTS = 32
#: Fingerprints with no more rows than this are never treated as frequent.
FEW_COPIES = 1000
RADIUS = 3
#: Of the 32 bits of half a fingerprint: the lower bit of each segment.
LOW_BITS = 0x55555555


def simhash(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text: a bit is set if it is set in over half of the shingles' hashes."""
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not found:
        return 0
    line, h64 = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return h64(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    first = np.concatenate([[0], ends[:-words] + 1])
    last, n = ends[words - 1 :], len(found) - words + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        some = [h64(line[a:b], SEED) for a, b in zip(first[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist(), strict=True)]
        ones += np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long (the same 64 bits)."""
    workers_can_import(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1):
            fps = np.fromiter((simhash(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(of, "id long, fp long")


def _half(fp: Column, k: int) -> Column:
    """The embedding of half a fingerprint: 16 counts of 0, 1 or 2, each in its own 2 bits of a long."""
    half = F.shiftrightunsigned(fp, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))
    return half.bitwiseAND(F.lit(LOW_BITS)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(LOW_BITS))


def _near_cells(half: Column) -> Column:
    """The grid cell itself and those one step along one axis."""
    moves = F.array(*[
        F.when(F.shiftrightunsigned(half, 2 * i).bitwiseAND(F.lit(3)) != (2 if up else 0), half + F.lit((1 if up else -1) << (2 * i)))
        for i in range(SEGMENTS // 2) for up in (True, False)
    ])
    return F.concat(F.array(half), F.filter(moves, lambda x: x.isNotNull()))


def _steps(fp: Column) -> Column:
    """The embedding of a whole fingerprint with its counts as steps: 0, 1 and 2 as 00, 01 and 11. So the number of bits in
    which two of them differ is the Manhattan distance of the counts."""
    low, high = fp.bitwiseAND(F.lit(LOW_BITS << 32 | LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS << 32 | LOW_BITS))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def links(fps: DataFrame) -> DataFrame:
    """(a, b) with a < b: every pair of the distinct longs in column fp that differ in 1 to 3 bits, once."""
    halves = fps.select("fp", _steps(F.col("fp")).alias("steps"), F.posexplode(F.array(_half(F.col("fp"), 0), _half(F.col("fp"), 1))).alias("part", "cell"))
    asks = halves.select(F.col("fp").alias("a"), F.col("steps").alias("a_steps"), "part", F.explode(_near_cells(F.col("cell"))).alias("cell"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("fp")))
    bound = F.bit_count(F.col("a_steps").bitwiseXOR(F.col("steps")))
    near = (asks["part"] == halves["part"]) & (asks["cell"] == halves["cell"]) & (F.col("a") < F.col("fp")) & (bound <= RADIUS) & (apart <= RADIUS)
    return asks.join(halves, near).select("a", F.col("fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edges (a, b), the smallest node that it reaches."""
    return connected_components(edges).withColumnRenamed("component", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hexadecimal digits, and the smallest id reachable over
    links of 3 or fewer differing bits, its own included."""
    prints = cut(fingerprints(docs, id_col, text_col))
    groups = cut(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    roots = cut(components(links(groups)))
    named = roots.join(groups, roots["node"] == groups["fp"])
    lowest = named.groupBy("root").agg(F.min("low").alias("lowest"))
    joined = named.join(lowest, "root").select("fp", "lowest")
    of_fp = cut(groups.join(joined, "fp", "left").select("fp", F.coalesce("lowest", "low").alias("component_id"), "n"))
    # Copies beyond a thousandth of the rows: at most a thousand fingerprints, so these are broadcast and their rows stay put.
    many = max(FEW_COPIES, (groups.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot, others = of_fp.where(F.col("n") > many).drop("n"), of_fp.where(F.col("n") <= many).drop("n")
    rest = prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(others, "fp")
    found = prints.join(F.broadcast(hot), "fp").select("fp", "id", "component_id").union(rest.select("fp", "id", "component_id"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, of each near-duplicate group only the document with the smallest id.

    Rows that repeat a kept id are dropped but for one of them; rows without an id can't be told apart and stay.
    """
    found = cut(near_duplicates(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), "component_id"))
    kept = docs.join(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), id_col, "left_anti")
    repeated = cut(found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col])
    return kept.join(repeated, id_col, "left_anti").select(docs.columns).union(once.select(docs.columns))
