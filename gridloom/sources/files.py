"""Reading and writing of CSV and JSON, as files and as short texts, and made-up data sets."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources import quoted


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = True, null_value: str = "", keep_strings: bool = False, line_breaks: bool = True) -> DataFrame:
    """A CSV file with quoted fields; a ragged row is an error. Without a header the columns are column_0 and so on.

    line_breaks: whether quoted fields may hold any. Large files are cut and read by many tasks either way.
    """
    if line_breaks:
        df = quoted.read(spark, path, delimiter, has_header, null_value)
        return df if keep_strings or not df.columns else _inferred(df, ("int", *KINDS))
    reader = spark.read.options(sep=delimiter, header=has_header, nullValue=null_value, mode="FAILFAST", quote='"', escape='"', inferSchema=not keep_strings)
    df = reader.csv(path)
    return df if has_header else df.toDF(*(f"column_{i}" for i in range(len(df.columns))))


#: Text given to or made by the functions on strings is at most so long, or has so many rows: it lies on the driver.
MOST_TEXT, MOST_ROWS = 16 << 20, 10_000


KINDS = ("bigint", "double", "boolean")


def _inferred(df: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Columns of text as the narrowest type that all their values have: whole numbers, numbers, booleans, or text."""
    fits = df.agg(*(F.coalesce(F.every(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast(k).isNotNull()), F.lit(False)).alias(f"{i}_{k}") for i, c in enumerate(df.columns) for k in kinds)).first()
    kind = lambda i: next((k for k in kinds if fits[f"{i}_{k}"]), "string")
    return df.select(*(F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(df.columns)))


def read_csv_from_string(spark: SparkSession, text: str, delimiter: str = ",", has_header: bool = True, null_value: str = "", keep_strings: bool = False) -> DataFrame:
    """A short CSV text with quoted fields and line breaks inside them; a ragged row is an error, blank lines are none."""
    if len(text) > MOST_TEXT:
        raise ValueError("too long a text: write it to a file")
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter, strict=True) if r]
    header = rows.pop(0) if has_header and rows else None
    width = len(header) if header is not None else len(rows[0]) if rows else 0
    if any(len(r) != width for r in rows):
        raise ValueError("rows differ in their number of fields")
    names = header if header is not None else [f"column_{i}" for i in range(width)]
    if not names:
        return spark.range(0).select()
    df = spark.createDataFrame([[None if v == null_value else v for v in r] for r in rows], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return df if keep_strings else _inferred(df)


def _few(df: DataFrame, most_rows: int) -> list:
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    return rows


def to_csv_string(df: DataFrame, delimiter: str = ",", header: bool = True, null_value: str = "", most_rows: int = MOST_ROWS) -> str:
    """A short frame as CSV, with quotes where needed."""
    out = io.StringIO()
    writer = csv.writer(out, delimiter=delimiter, lineterminator="\n")
    if header:
        writer.writerow(df.columns)
    text = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null_value)).alias(c) for c in df.columns))
    writer.writerows(map(tuple, _few(text, most_rows)))
    return out.getvalue()


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, null_value: str = "", mode: str = "error") -> None:
    df.write.mode(mode).options(sep=delimiter, header=header, nullValue=null_value, quote='"', escape='"').csv(path)


def read_json(spark: SparkSession, path: str, columns: list[str] | None = None, array: bool | None = None) -> DataFrame:
    """Flat JSON objects; a missing key is null, nested values become null. columns sets their order.

    array: whether a file is one array (read by one task) or has an object a line, as `write_json` writes; told from the
    first line, if it isn't given.
    """
    if array is None:
        first = spark.read.text(path).where(F.trim("value") != "").first()
        array = first is not None and first["value"].lstrip().startswith("[")
    return _flat(spark.read.option("multiLine", array).json(path), columns)


def _flat(df: DataFrame, columns: list[str] | None) -> DataFrame:
    flat = [F.lit(None).cast("string").alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`") for f in df.schema]
    df = df.select(*flat)
    return df.select(*columns) if columns else df


def from_json_string(spark: SparkSession, text: str, columns: list[str] | None = None) -> DataFrame:
    """A short JSON array of flat objects."""
    if len(text) > MOST_TEXT:
        raise ValueError("too long a text: write it to a file")
    kind = spark.range(1).select(F.schema_of_json(F.lit(text))).first()[0]
    rows = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", kind).alias("a"))
    return _flat(rows.select(F.inline("a")), columns)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object a line, nulls written out."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def to_json_string(df: DataFrame, most_rows: int = MOST_ROWS) -> str:
    """A JSON array of a small frame's rows, for messages and tests."""
    rows = _few(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")), most_rows)
    return "[" + ",".join(r["j"] for r in rows) + "]"


def chance(seed: int, n: int = 0) -> Column:
    """A number from 0 to 1 of the row's id, a seed and a place, the same however the rows are dealt out."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(n), F.col("id")), 11) + 0.5) / float(1 << 53)


def normal(seed: int, n: int = 0) -> Column:
    """A number of the standard normal distribution, by the same."""
    return F.sqrt(-2 * F.log(chance(seed, 2 * n))) * F.cos(2 * F.pi() * chance(seed, 2 * n + 1))


def make_blobs(spark: SparkSession, n: int, centers: list[tuple[float, float]], spread: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, x, y, label): points around centres, in turn."""
    at = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in centers])
    df = spark.range(n).withColumn("label", (F.col("id") % len(centers)).cast("int")).withColumn("c", at[F.col("label")])
    return df.select("id", (F.col("c.x") + spread * normal(seed)).alias("x"), (F.col("c.y") + spread * normal(seed, 1)).alias("y"), "label")


def make_regression(spark: SparkSession, n: int, weights: list[float], bias: float = 0.0, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(id, x0.., y): y is linear in the features but for noise."""
    df = spark.range(n).select("id", *(normal(seed, i).alias(f"x{i}") for i in range(len(weights))))
    y = sum((w * F.col(f"x{i}") for i, w in enumerate(weights)), F.lit(bias))
    return df.withColumn("y", y + noise * normal(seed, len(weights)))


def make_moons(spark: SparkSession, n: int, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(id, x, y, label): two half circles that reach into each other."""
    df = spark.range(n).withColumn("label", (F.col("id") % 2).cast("int")).withColumn("a", chance(seed, 9) * F.pi())
    x = F.when(F.col("label") == 0, F.cos("a")).otherwise(1 - F.cos("a"))
    y = F.when(F.col("label") == 0, F.sin("a")).otherwise(0.5 - F.sin("a"))
    return df.select("id", (x + noise * normal(seed, 1)).alias("x"), (y + noise * normal(seed, 2)).alias("y"), "label")


def make_classification(spark: SparkSession, n: int, features: int = 2, apart: float = 2.0, seed: int = 0) -> DataFrame:
    """(id, x0.., label): two clouds whose centres lie `apart` from each other in every feature."""
    df = spark.range(n).withColumn("label", (F.col("id") % 2).cast("int"))
    return df.select("id", *((F.col("label") * apart + normal(seed, i)).alias(f"x{i}") for i in range(features)), "label")


def make_circles(spark: SparkSession, n: int, inner: float = 0.5, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """(id, x, y, label): a circle (0) around a smaller one (1)."""
    df = spark.range(n).withColumn("label", (F.col("id") % 2).cast("int")).withColumn("a", 2 * F.pi() * chance(seed, 9))
    r = F.when(F.col("label") == 1, inner).otherwise(1.0)
    return df.select("id", (r * F.cos("a") + noise * normal(seed, 1)).alias("x"), (r * F.sin("a") + noise * normal(seed, 2)).alias("y"), "label")


def make_spirals(spark: SparkSession, n: int, turns: float = 1.5, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """(id, x, y, label): two arms that wind around each other."""
    df = spark.range(n).withColumn("label", (F.col("id") % 2).cast("int")).withColumn("r", F.sqrt(chance(seed, 9)))
    a = F.col("r") * turns * 2 * F.pi() + F.col("label") * F.pi()
    return df.select("id", (F.col("r") * F.cos(a) + noise * normal(seed, 1)).alias("x"), (F.col("r") * F.sin(a) + noise * normal(seed, 2)).alias("y"), "label")


def batches(df: DataFrame, size: int, key: str, seed: int = 0) -> DataFrame:
    """df with batch: rows in an order of chance, `size` to a batch, the last of which may be smaller."""
    from gridloom.operators import rows, running

    placed = running.numbered(df.withColumn("__h", rows.by_chance(key, seed)), ["__h", key], "__at")
    return placed.select(*df.columns, F.floor(F.col("__at") / size).cast("long").alias("batch"))
