"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's reader only."""
    workers_can_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_can_import(spark: SparkSession) -> None:
    """Puts this package's folder on the Python workers' path.

    On a cluster the package is installed or shipped with --py-files; then this entry is simply unused.
    """
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder for data between jobs that all executors reach: the one the cluster names in spark.checkpoint.dir. On one
    machine (as in tests) a temporary one, if that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, so that a lost executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def join_hot(left: DataFrame, right: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """left joined to right, which has one row for each key, however often a key stands in left: keys with over 1/most of
    left's rows, of which there are fewer than `most`, are joined by broadcast, the rest by shuffle. Null keys join nothing."""
    counts = left.groupBy(key).agg(F.count("*").alias("__n"))
    limit = (counts.agg(F.sum("__n")).first()[0] or 0) / most
    if limit < 1:
        return left.join(right, key)
    hot = F.broadcast(right.join(F.broadcast(counts.where(F.col("__n") > limit).select(key)), key, "left_semi"))
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(right, key))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that isn't needed any more, wherever Spark can reach it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fold kept for evaluation: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


class ChunkCache(dict):
    """chunk -> encoding, filled on demand by encode(chunk); emptied when it holds `most` entries, which bounds memory.

    Long chunks are encoded anew each time, as few repeat and they would take most of the room.
    """

    def __init__(self, encode, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.encode, self.most, self.longest = encode, most, longest

    def __missing__(self, chunk):
        out = self.encode(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = out
        return out


def blocks(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of rows of about most_bytes in the given column; one longer text stands alone."""
    for b in batches:
        at = 0
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        while at < b.num_rows:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(sizes.searchsorted(done + most_bytes, side="right")))
            yield b.slice(at, to - at)
            at = to
