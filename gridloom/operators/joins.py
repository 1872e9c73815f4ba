"""Joins on equal keys, with suffixes and an indicator, and the nearest earlier row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import scans


def merge(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, how: str = "inner", suffix: str = "_y", indicator: bool = False) -> DataFrame:
    """Keys take the left value, else the right; a right column of a known name gets the suffix; right keys of other names
    stay. With indicator, _merge is both, left_only or right_only. Null keys match nothing."""
    right_on = right_on or left_on
    renamed = right.select(*(F.col(c).alias(f"__{c}") for c in right.columns), F.lit(True).alias("__r"))
    both = left.withColumn("__l", F.lit(True)).join(renamed, [F.col(a) == F.col(f"__{b}") for a, b in zip(left_on, right_on, strict=True)], {"outer": "full"}.get(how, how))
    out = [F.coalesce(F.col(a), F.col(f"__{b}")).alias(a) for a, b in zip(left_on, right_on, strict=True)]
    out += [F.col(c) for c in left.columns if c not in left_on]
    for c in right.columns:
        if c not in right_on or c not in left_on:
            out.append(F.col(f"__{c}").alias(c + suffix if c in left.columns else c))
    if indicator:
        out.append(F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both").alias("_merge"))
    return both.select(*out)


def semi_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None) -> DataFrame:
    return left.join(right.select(F.col(right_on or left_on).alias("__k")), F.col(left_on) == F.col("__k"), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None) -> DataFrame:
    """Left rows without a match; rows with a null key stay."""
    return left.join(right.select(F.col(right_on or left_on).alias("__k")), F.col(left_on) == F.col("__k"), "left_anti")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, tie: str) -> DataFrame:
    """Beside each left row the right value with the same key at the latest time up to its own: both sides in one column of rows,
    so no pairs are formed. Keys with over a hundredth of all rows are cut into ranges of time, as `scans` does."""
    l_cols = [c for c in left.columns if c not in (by, at)]
    a = left.select(by, at, F.lit(1).alias("__side"), F.struct(*l_cols).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.col(tie).alias("__t"))
    b = right.select(by, at, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"), F.col(tie).alias("__t"))
    both, order = a.union(b), [at, "__side", "__t"]
    out = [by, at, "__row.*", F.col("__v").alias(f"{value}_as_of")]
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda rows: rows.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(*out)
    hot = scans.hot_keys(both.select(by), [by])
    if hot is None:
        return last(both)
    keys = F.broadcast(hot.withColumnRenamed(by, "__k"))
    same = F.col(by).eqNullSafe(F.col("__k"))
    split = scans.filled(both.join(keys, same, "left_semi"), "__v", "__w", [by], order)
    return last(both.join(keys, same, "left_anti")).unionByName(split.where("__side = 1").drop("__v").withColumnRenamed("__w", "__v").select(*out))
