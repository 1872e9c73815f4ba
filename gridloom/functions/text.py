"""String and date columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(c: str, part: str) -> Column:
    return F.col(c).contains(part)


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def replace(c: Column, old: str, new: str, count: int | None = None) -> Column:
    """The literal text, at most count times."""
    if count is None:
        return F.replace(c, F.lit(old), F.lit(new))
    return F.array_join(F.split(c, re.escape(old), count + 1), new)


def piece(c: Column, delimiter: str, i: int) -> Column:
    """The i-th part from 0; null beyond the last."""
    return F.try_element_at(F.split(c, re.escape(delimiter)), F.lit(i + 1))


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def pad_left(c: Column, width: int, char: str = " ") -> Column:
    """To a width in bytes; never cut."""
    return F.when(F.octet_length(c) < width, F.concat(F.repeat(F.lit(char), width - F.octet_length(c)), c)).otherwise(c)


DATE_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "dow": F.weekday, "hour": F.hour}


def date_parts(c: str, parts: list[str]) -> list[Column]:
    """{column}_{part} by the calendar; dow is 0 on Monday."""
    return [DATE_PARTS[p](c).alias(f"{c}_{p}") for p in parts]
