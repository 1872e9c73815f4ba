"""Structured Streaming over events: windows of time, sessions, running moments, and repeated events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replay(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, so many at a time."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, width: str, late: str = "1 hour", key: str = "event_type", value: str = "value", slide: str | None = None) -> DataFrame:
    """Counts and sums for each window and key; rows later than the watermark are dropped from a stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(w.alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Runs of a key's events with less than the gap between them."""
    grouped = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(F.session_window("ts", gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def running_moments(events: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """Count, mean, variance, skewness and kurtosis so far; values that aren't finite are passed over."""
    x = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    return events.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"), F.min(x).alias("low"), F.max(x).alias("high"))


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def last_n(events: DataFrame, n: int, key: str = "event_type", order: tuple[str, str] = ("ts", "event_id"), value: str = "value") -> DataFrame:
    """The last n events of each key: what a bounded buffer that drops the oldest would show.

    Over a batch, the rows themselves. In a stream, (key, at, id, value) arrays after each micro-batch that brings events
    of the key, oldest first; the state is n events a key.
    """
    if not events.isStreaming:
        w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
        return events.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
    kind = dict(events.dtypes)[key]
    some = events.select(F.col(key).alias("key"), F.unix_micros(F.col(order[0]).cast("timestamp")).alias("at"), F.col(order[1]).cast("long").alias("id"), F.col(value).cast("double").alias("value"))
    fields = ("at", "id", "value")

    def follow(k: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(dict(zip(fields, held.get, strict=True))) if held.exists else None
        for b in batches:
            kept = pd.concat([x for x in (kept, b[list(fields)]) if x is not None]).sort_values(["at", "id"]).tail(n)
        lists = tuple(kept[f].tolist() for f in fields)
        held.update(lists)
        yield pd.DataFrame({"key": [k[0]], **{f: [v] for f, v in zip(fields, lists, strict=True)}})

    arrays = "at array<long>, id array<long>, value array<double>"
    return some.groupBy("key").applyInPandasWithState(follow, f"key {kind}, {arrays}", arrays, "update", "NoTimeout")


def enriched(events: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each event with its row of a table that doesn't change, nulls where there is none; in a stream, batch by batch."""
    return events.join(table, key, "left")
