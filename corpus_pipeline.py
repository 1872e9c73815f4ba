"""A corpus pipeline: quality, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents. It needs the subpackage `gridloom.llm`, and goes with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import best_fit_packing, language_id, quality_gam, simhash_dedup
from gridloom.llm.common import held_out, shared_folder, table
from gridloom.llm.queries import byte_bpe

#: Documents whose quality score is below this go.
LEAST_QUALITY = 0.3
#: Documents go that are ambiguous or fit their language worse than all but this share of the rows it is learned from.
LOSE = 0.005


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts."""
    return quality_gam.keep_good(docs, quality_gam.fit(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is known and beyond doubt."""
    return language_id.keep_certain(docs, language_id.fit(docs, F.col("lang"), ~held_out(), lose=LOSE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash_dedup.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    return best_fit_packing.pack(docs, byte_bpe(), capacity=2048)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", packing)]
#: The classifiers and the tokenizer can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir. What the stages hand on is written to the shared folder, and
    removed once the next stage is written; the last stage's rows stay there, as the result is read from them."""
    folder, docs, before = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}", table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
