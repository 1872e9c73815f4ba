"""CSV whose quoted fields may hold line breaks, read by many tasks a file.

Spark cuts files into ranges of whole lines. A first pass counts the quotes of each range; their parities, one row a range, tell
whether a range starts inside a quoted field. A second pass puts lines together to records within each range; only the lines at its
start that end a record of an earlier range, and a last record that isn't ended, are joined to each other afterwards.

Every quote opens or closes, and two within a quoted field are one; a record ends with a line feed, or a carriage return and
one, outside quotes; blank lines are none. A field that equals null_value is null, quoted or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.running import checkpointed

#: What a piece of a range is: a record, the end of one that an earlier range began, one that goes on in the next range.
WHOLE, END, OPEN = 0, 1, 2
_PIECES = "file string, start long, kind int, first boolean, text string"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines in order, range by range, to pieces."""
    at, made, lines, inside, head, first = None, [], [], False, False, False

    def done(kind: int) -> None:
        made.append((*at, kind, first, "\n".join(lines)))
        lines.clear()

    def left() -> None:
        if lines:  # a range that lies within one field has an end that doesn't end anything
            done(END if head else OPEN)

    for b in batches:
        for file, start, odd, line in zip(b["file"], b["start"], b["odd"], b["value"], strict=True):
            if (file, start) != at:
                left()
                at, inside, head, first = (file, start), bool(odd), bool(odd), start == 0
            lines.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                done(END if head else WHOLE)
                head = first = False
        yield pd.DataFrame(made, columns=["file", "start", "kind", "first", "text"])
        made.clear()
    left()
    yield pd.DataFrame(made, columns=["file", "start", "kind", "first", "text"])


def fields(record: str, delimiter: str) -> list[str]:
    """A record's fields, without their quotes."""
    if '"' not in record:
        return record.split(delimiter)
    made, parts = [""], record.split('"')
    for i, part in enumerate(parts):
        if i % 2:  # within quotes
            made[-1] += part
        elif not part and 0 < i < len(parts) - 1:
            made[-1] += '"'
        else:
            first, *more = part.split(delimiter)
            made[-1] += first
            made += more
    return made


def records(spark: SparkSession, path: str) -> DataFrame:
    """(first, text): each record of the files, blank ones left out; first is true for the first of a file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = checkpointed(lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd")))
    if ranges.groupBy("file").agg((F.sum("odd") % 2).alias("odd")).where("odd = 1").limit(1).count():
        raise ValueError("unbalanced quotes")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("odd"))
    # The join is by broadcast, one row a range, so lines stay in their order.
    pieces = lines.join(F.broadcast(starts), ["file", "start"]).select("file", "start", "odd", "value").mapInPandas(_pieces, _PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("first", "text")
    # An open record and the ends up to the next open one belong together: at most two pieces a range.
    cut = checkpointed(pieces.where(F.col("kind") != WHOLE))
    order = Window.partitionBy("file").orderBy("start", "kind")
    which = cut.withColumn("record", F.count_if(F.col("kind") == OPEN).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = which.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))).alias("p"), F.bool_or("first").alias("first"))
    joined = parts.select("first", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    both = whole.unionByName(joined).withColumn("text", F.regexp_replace("text", "\\r\\z", ""))
    return both.withColumn("text", F.when(F.col("first"), F.regexp_replace("text", "\\A\ufeff", "")).otherwise(F.col("text"))).where("text <> ''")


def read(spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = True, null_value: str = "") -> DataFrame:
    """The files' records as columns of text; those with another number of fields than the first are an error."""
    rows = records(spark, path)
    top = [fields(r["text"], delimiter) for r in rows.where("first").select("text").distinct().limit(2).collect()]
    if not top:
        return spark.range(0).select()
    if has_header and len(top) > 1:
        raise ValueError("files differ in their headers")
    names = top[0] if has_header else [f"column_{i}" for i in range(len(top[0]))]
    width, inner = len(names), [f"c{i}" for i in range(len(names))]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = [fields(t, delimiter) for t in b["text"]]
            if any(len(c) != width for c in cells):
                raise ValueError("rows differ in their number of fields")
            yield pd.DataFrame([[None if v == null_value else v for v in c] for c in cells], columns=inner, dtype=object)

    body = rows.where("not first") if has_header else rows
    return body.select("text").mapInPandas(split, ", ".join(f"{c} string" for c in inner)).toDF(*names)
