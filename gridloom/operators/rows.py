"""Rows: order, top rows, duplicates, samples and splits of exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import running


def sort_by(df: DataFrame, column: str, ascending: bool = True, tie: tuple[str, ...] = ()) -> DataFrame:
    c = F.col(column)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *tie)


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def drop_duplicates(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The first row by the order of each set of equal values: a min_by over the rest, combined before the shuffle."""
    rest = [c for c in df.columns if c not in columns]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return df.groupBy(*columns).agg(first).select(*columns, "__first.*").select(*df.columns)


def duplicated(partition: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) > 1


def by_chance(key: str, seed: int) -> Column:
    """A number from 0 to 2^60 that depends on the row's key and the seed only, so that a repeated task draws the same rows,
    and other engines too: the first digits of an MD5 of both."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


def _bound(df: DataFrame, n: int, key: str, seed: int, most: int = 100_000) -> tuple[int, object] | None:
    """The n-th smallest (chance, key), found by counts of ever finer ranges of chance; None if there are no more than n rows."""
    rows, bits, low = df.select(by_chance(key, seed).alias("h"), key), 60, 0
    left = n
    while True:
        width = max(0, bits - 12)
        counts = sorted((r["at"], r["n"]) for r in rows.groupBy(F.shiftright(F.col("h") - low, width).alias("at")).agg(F.count("*").alias("n")).collect())  # 4096 rows at most
        if sum(c for _, c in counts) <= left:
            return None
        for at, c in counts:
            if left <= c:
                break
            left -= c
        rows, low, bits = rows.where(F.shiftright(F.col("h") - low, width) == at), low + (at << width), width
        if c <= most or not bits:
            found = rows.orderBy("h", key).limit(left).agg(F.max(F.struct("h", key)).alias("e")).first()["e"]
            return found["h"], found[key]


def _drawn(df: DataFrame, n: int, key: str, seed: int) -> Column:
    if n <= 0:
        return F.lit(False)
    bound = _bound(df, n, key, seed)
    h = by_chance(key, seed)
    return F.lit(True) if bound is None else (h < bound[0]) | (h == bound[0]) & (F.col(key) <= F.lit(bound[1]))


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if fewer), without replacement; keys must be unique. Rows stay where they lie: each is kept or
    not by a bound on its chance."""
    return df.where(_drawn(df, n, key, seed))


def shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(by_chance(key, seed), key)


def numbered_shuffle(df: DataFrame, key: str, out: str, seed: int = 0) -> DataFrame:
    """df with each row's place, from 0, in the order that `shuffle` gives, without a sort in one task."""
    return running.numbered(df.withColumn("__chance", by_chance(key, seed)), ["__chance", key], out).drop("__chance")


def train_test_split(df: DataFrame, test_size: float, key: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Exactly round(n * test_size) rows for the test; keys must be unique and known."""
    test = _drawn(df, round(df.count() * test_size), key, seed)
    return df.where(~test), df.where(test)


def fold(key: str, k: int, seed: int = 0) -> Column:
    """A fold from 0 to k-1 by the key alone."""
    return (by_chance(key, seed) % k).cast("int")


def _within(df: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """df with __at, each row's place in its stratum by chance, from 0, and __n, the stratum's rows. Rows are numbered by ranges
    of all strata as one column, so no task sees a whole stratum."""
    placed = running.numbered(df.withColumn("__h", by_chance(key, seed)), [*strata, "__h", key], "__at")
    starts = placed.groupBy(*(F.col(c).alias(f"__s{i}") for i, c in enumerate(strata))).agg(F.min("__at").alias("__start"), F.count("*").alias("__n"))
    same = F.lit(True)
    for i, c in enumerate(strata):
        same &= F.col(c).eqNullSafe(F.col(f"__s{i}"))
    return placed.join(starts, same).withColumn("__at", F.col("__at") - F.col("__start")).select(*df.columns, "__at", "__n")


def even_folds(df: DataFrame, k: int, key: str, seed: int = 0, strata: list[str] = ()) -> DataFrame:
    """df with fold: of sizes that differ by one at most, in each stratum if any are named."""
    return _within(df, list(strata), key, seed).select(*df.columns, (F.col("__at") % k).cast("int").alias("fold"))


def time_series_splits(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """df with block, 0 to k by the order: split i trains on the blocks below i and tests on block i, for i from 1 to k."""
    placed, n = running.numbered(df, order, "__at"), df.count()
    return placed.select(*df.columns, F.floor(F.col("__at") * (k + 1) / max(1, n)).cast("int").alias("block"))


def stratified_sample(df: DataFrame, share: float, strata: list[str], key: str, seed: int = 0) -> DataFrame:
    """round(share * n) rows of each stratum's n."""
    return _within(df, strata, key, seed).where(F.col("__at") < F.round(F.col("__n") * share)).select(df.columns)


def select_rows(df: DataFrame, positions: DataFrame, order: list[str]) -> DataFrame:
    """The rows at some positions (position), from 0 by the order, as often as they are named; one out of bounds is an error."""
    wanted = positions.select(F.col("position").cast("long").alias("__p"))
    found = wanted.join(running.numbered(df, order, "__at"), F.col("__p") == F.col("__at"), "left")
    checked = F.when(F.col("__at").isNull(), F.raise_error(F.concat(F.lit("no row at position "), F.col("__p"))).cast("boolean")).otherwise(F.lit(True))
    return found.where(checked).select(df.columns)
