"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The work on texts (tokenising, cutting, checksums) runs in Spark tasks. Packing itself needs only the number of
pieces of each length, at most `capacity` numbers however large the corpus, so it is done on that histogram: runs of
equal sequences are formed, not single ones. Then every piece takes its place by the rank it has among the pieces of
its length, which is looked up in the runs.

Large-item matching: pieces above a third of the capacity ("large") meet at most twice in a sequence, so they are
matched greedily: from the longest down, each takes the longest partner that still fits. Smaller pieces then go,
again from the longest, where they leave the smallest gap (best fit), and into new sequences where no gap is left.

What happens in each case: a null or empty text is the single end token; a text longer than the capacity is cut into
pieces of the capacity, the first of which may be shorter, and only such texts are cut; equal and repeated rows are
packed each for itself; an empty table gives an empty result; a null doc_id is packed like any other; further columns
are ignored by `pack`, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import ChunkCache, blocks, cut, workers_can_import

#: A blank after white space, where chunks that begin with a blank can't be encoded one by one.
WIDE_SPACE = re.compile(r"\s ")
#: Pieces of one length are ranked in so many separate groups at least, so that a frequent length is no single task.
SPREAD = 64


@cache
def _encoder(ranks_path: str, pattern: str, end_text: str, end_id: int):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={end_text: end_id})
    return enc, ChunkCache(lambda s: np.array(enc.encode_ordinary(s), "<u4").tobytes())


def token_ids(text: str, ranks_path: str, pattern: str, end_text: str, end_id: int) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers.

    Byte-level BPE never joins over the blank that begins a word, so the text is cut at single blanks and each
    chunk is looked up; texts with wider white space or the special token are encoded whole.
    """
    enc, chunks = _encoder(ranks_path, pattern, end_text, end_id)
    if end_text in text or WIDE_SPACE.search(text):
        return np.array(enc.encode(text, allowed_special="all"), "<u4").tobytes()
    first, *rest = text.split(" ")
    return b"".join([chunks[first], *map(chunks.__getitem__, map(" ".__add__, rest))])


def pieces(docs: DataFrame, tokenizer: dict, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece. tokenizer: the arguments of `token_ids`."""
    workers_can_import(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1):
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = token_ids(text or "", **tokenizer) + tail
                n = len(ids) // 4
                start, stop = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    out.append((key, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop = stop, stop + capacity
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    kinds, names = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), ["doc_id", "piece", "start", "length", "ids_crc32"]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(of, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (count, lengths) of equal sequences that hold each length exactly histogram[length] times."""
    left = {n: c for n, c in histogram.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    small = sorted((n for n in left if 3 * n <= capacity), reverse=True)
    runs: list[tuple[int, tuple[int, ...]]] = []
    #: gap -> runs with that gap; gaps: its keys in order
    open_runs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    gaps: list[int] = []

    def put(count: int, lengths: tuple[int, ...], gap: int) -> None:
        if gap == 0:
            runs.append((count, lengths))
            return
        if gap not in open_runs:
            insort(gaps, gap)
        open_runs.setdefault(gap, []).append((count, lengths))

    while large:
        n = large[-1]
        fits = bisect_left(large, capacity - n + 1) - 1
        m = large[fits] if fits >= 0 else None
        if m == n and left[n] == 1:
            m = large[fits - 1] if fits > 0 else None
        if m is None:
            put(left[n], (n,), capacity - n)
            left[n] = 0
        else:
            count = left[n] // 2 if m == n else min(left[n], left[m])
            put(count, (n, m), capacity - n - m)
            left[n] -= count
            left[m] -= count
        large = [x for x in (large if m is None or left[m] else [y for y in large if y != m]) if left[x]]
    for n in small:
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                count, over = divmod(left[n], each)
                if count:
                    put(count, (n,) * each, capacity - n * each)
                if over:
                    put(1, (n,) * over, capacity - n * over)
                left[n] = 0
                break
            gap = gaps[at]
            count, lengths = open_runs[gap].pop()
            if not open_runs[gap]:
                del open_runs[gap], gaps[at]
            each = min(gap // n, left[n])
            take = min(count, left[n] // each)
            put(take, lengths + (n,) * each, gap - n * each)
            left[n] -= take * each
            if count > take:
                put(count - take, lengths, gap)
    return runs + [run for found in open_runs.values() for run in found]


def _places(runs: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, rank step, first sequence, offsets) arrays over the runs that hold it.

    In a run, rank r of a length that occurs k times in a sequence goes to sequence (r - first) // k.
    """
    found: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for count, lengths in runs:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in lengths:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, places in offsets.items():
            found.setdefault(n, []).append((ranks.get(n, 0), len(places), base, places))
            ranks[n] = ranks.get(n, 0) + count * len(places)
        base += count
    return {n: (np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows]), [np.array(x[3]) for x in rows]) for n, rows in found.items()}


def pack(docs: DataFrame, tokenizer: dict, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence_id and offset; see `pieces` for the other columns."""
    spark = docs.sparkSession
    all_pieces = cut(pieces(docs, tokenizer, capacity, end, id_col, text_col))
    # Ranks within a length: first within (length, part), then the parts of a length one after another.
    # Equal rows are told apart by the partition of the checkpoint that they lie in, the same whenever it is read.
    split = all_pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.spark_partition_id()), F.lit(max(SPREAD, 4 * all_pieces.rdd.getNumPartitions()))))
    counts = cut(split.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = split.withColumn("rank", F.row_number().over(order)).join(before.select("length", "part", "before"), ["length", "part"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank, length = b.pop("rank").to_numpy(), b["length"].to_numpy()
            seq, off = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                starts, steps, bases, offsets = places.value[int(n)]
                run = np.searchsorted(starts, rank[rows], side="right") - 1
                inside = rank[rows] - starts[run]
                seq[rows] = bases[run] + inside // steps[run]
                off[rows] = [offsets[k][i] for k, i in zip(run.tolist(), (inside % steps[run]).tolist(), strict=True)]
            yield b.assign(sequence_id=seq, offset=off)

    kept = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.coalesce("before", F.lit(0))).alias("rank"))
    return kept.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
