"""Labels of rows, kept as columns: an Indexed frame knows which of its columns are its index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import running


@dataclass(frozen=True)
class Indexed:
    df: DataFrame
    index: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.index]

    def reset_index(self) -> DataFrame:
        """The index as columns level_0 and so on, in front."""
        return self.df.select(*(F.col(c).alias(f"level_{i}") for i, c in enumerate(self.index)), *self.columns)

    def swaplevel(self, i: int = -2, j: int = -1) -> Indexed:
        levels = list(self.index)
        levels[i], levels[j] = levels[j], levels[i]
        return Indexed(self.df, tuple(levels))

    def is_unique(self) -> bool:
        return is_unique(self.df, list(self.index))

    def loc(self, *labels: str) -> DataFrame:
        """The rows whose first levels have these labels."""
        hit = F.lit(True)
        for c, label in zip(self.index, labels, strict=False):
            hit &= F.col(c) == label
        return self.df.where(hit).select(self.columns)

    def sort_index(self) -> Indexed:
        return Indexed(self.df.orderBy(*self.index), self.index)


def set_index(df: DataFrame, columns: list[str]) -> Indexed:
    """df with some columns, as text, for its index."""
    return Indexed(df.withColumns({c: F.col(c).cast("string") for c in columns}), tuple(columns))


def set_labels_index(df: DataFrame, labels: DataFrame, order: list[str], name: str = "label") -> Indexed:
    """df with the labels (position, label) as index, by the position of each row in the order; a label for each row is needed."""
    n = df.count()
    if labels.where(F.col("position").between(0, n - 1)).select("position").distinct().count() != n or labels.count() != n:
        raise ValueError("there must be one label for each row")
    placed = running.numbered(df, order, "__at").join(labels.select(F.col("position").alias("__at"), F.col("label").cast("string").alias(name)), "__at")
    return Indexed(placed.select(name, *df.columns), (name,))


def is_unique(df: DataFrame, columns: list[str]) -> bool:
    return df.groupBy(*columns).count().where("count > 1").isEmpty()


def category_codes(c: str, known: list) -> Column:
    """The place of a value among the known ones, -1 for others and null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, known)), F.col(c)) - 1, F.lit(-1)).cast("int")
