"""Queries of files and of whole frames turned, mixed up and cast."""

import uuid

from pyspark.sql import functions as F

from gridloom.operators import frame, rows, windows
from gridloom.operators.running import checkpoint_folder
from gridloom.registry import query
from gridloom.sources import files


def _written(df, write) -> str:
    """A new folder of a frame, which the session's checkpoint folder holds."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/files-{uuid.uuid4().hex}"
    write(df, path)
    return path


_LINES = "event_id || ',' || chr(10) || '\"' || event_type || '\"'"


@query("csv_files", f"SELECT event_id, CASE WHEN event_id % 7 <> 2 THEN value END AS value, {_LINES} AS note, event_id % 2 = 0 AS even FROM events")
def _(t):
    e = t("events").select("event_id", F.when(F.col("event_id") % 7 != 2, F.col("value")).alias("value"), F.concat("event_id", F.lit(',\n"'), "event_type", F.lit('"')).alias("note"), (F.col("event_id") % 2 == 0).alias("even"))
    found = files.read_csv(e.sparkSession, _written(e, files.write_csv))
    return found.withColumn("event_id", F.col("event_id").cast("long"))


@query("json_files", f"SELECT event_id, CASE WHEN event_id % 7 <> 2 THEN value END AS value, {_LINES} AS note FROM events")
def _(t):
    e = t("events").select("event_id", F.when(F.col("event_id") % 7 != 2, F.col("value")).alias("value"), F.concat("event_id", F.lit(',\n"'), "event_type", F.lit('"')).alias("note"))
    return files.read_json(e.sparkSession, _written(e, files.write_json), ["event_id", "value", "note"])


@query("transposed_regions", "SELECT 'nations' AS key, " + ", ".join(f"count(*) FILTER (n_regionkey = {i}) AS \"{i}\"" for i in range(5)) + " FROM nation UNION ALL SELECT 'first', " + ", ".join(f"min(n_nationkey) FILTER (n_regionkey = {i})" for i in range(5)) + " FROM nation")
def _(t):
    counted = t("nation").groupBy("n_regionkey").agg(F.count("*").alias("nations"), F.min("n_nationkey").cast("long").alias("first"))
    return frame.transpose(counted, "n_regionkey")


@query("shuffled_parts", "SELECT p_partkey, row_number() OVER (ORDER BY ('0x' || md5('4:' || p_partkey)[1:15])::BIGINT, p_partkey) - 1 AS place FROM part")
def _(t):
    return rows.numbered_shuffle(t("part").select("p_partkey"), "p_partkey", "place", seed=4)


@query("outliers_by_sorted_places", """
WITH s AS (SELECT list(l_extendedprice ORDER BY l_extendedprice) AS l, count(*) AS n FROM lineitem), e AS (SELECT l[n // 4 + 1] AS a, l[least(3 * n // 4, n - 1) + 1] AS b FROM s)
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem, e WHERE l_extendedprice < a - 0.3 * (b - a) OR l_extendedprice > b + 0.3 * (b - a)""")
def _(t):
    return windows.outlier_iqr(t("lineitem"), "l_extendedprice", 0.3, "far", between=False).where("far").select("l_orderkey", "l_linenumber", "l_partkey")


_CASTS = {
    "whole_to_number": ("CAST(l_linenumber AS DOUBLE)", lambda: F.col("l_linenumber").cast("double")),
    "whole_to_text": ("CAST(l_orderkey AS VARCHAR)", lambda: F.col("l_orderkey").cast("string")),
    "whole_to_flag": ("CAST(l_linenumber - 1 AS BOOLEAN)", lambda: (F.col("l_linenumber") - 1).cast("boolean")),
    "whole_to_short": ("CAST(l_linenumber AS SMALLINT)", lambda: F.col("l_linenumber").cast("short")),
    "number_to_whole": ("CAST(trunc(-l_extendedprice) AS BIGINT)", lambda: frame.to_integer(-F.col("l_extendedprice"))),
    "number_to_flag": ("l_tax <> 0", lambda: F.col("l_tax").cast("boolean")),
    "number_to_decimal": ("round(CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DOUBLE), 2)", lambda: F.round(F.col("l_extendedprice").cast("decimal(18,2)").cast("double"), 2)),
    "text_to_whole": ("TRY_CAST(CASE WHEN l_linenumber = 3 THEN 'x' ELSE CAST(l_partkey AS VARCHAR) END AS BIGINT)", lambda: F.when(F.col("l_linenumber") == 3, F.lit("x")).otherwise(F.col("l_partkey").cast("string")).try_cast("long")),
    "text_to_number": ("TRY_CAST(CASE WHEN l_linenumber = 3 THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS DOUBLE)", lambda: F.when(F.col("l_linenumber") == 3, F.lit("")).otherwise(F.col("l_quantity").cast("string")).try_cast("double")),
    "text_to_flag": ("TRY_CAST(CASE WHEN l_returnflag = 'A' THEN 'true' WHEN l_returnflag = 'N' THEN 'false' ELSE 'maybe' END AS BOOLEAN)", lambda: F.when(F.col("l_returnflag") == "A", "true").when(F.col("l_returnflag") == "N", "false").otherwise("maybe").try_cast("boolean")),
    "flag_to_whole": ("CAST(l_linenumber > 2 AS INTEGER)", lambda: (F.col("l_linenumber") > 2).cast("int")),
    "flag_to_text": ("CAST(l_linenumber > 2 AS VARCHAR)", lambda: (F.col("l_linenumber") > 2).cast("string")),
    "time_to_day": ("CAST(l_shipdate AS DATE)", lambda: F.col("l_shipdate").cast("date")),
    "day_to_text": ("CAST(CAST(l_shipdate AS DATE) AS VARCHAR)", lambda: F.col("l_shipdate").cast("date").cast("string")),
    "text_to_day": ("CAST(strftime(l_shipdate, '%Y-%m-%d') AS DATE)", lambda: F.date_format("l_shipdate", "yyyy-MM-dd").cast("date")),
}


@query("casts", "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"{sql} AS {n}" for n, (sql, _) in _CASTS.items()) + " FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *(f().alias(n) for n, (_, f) in _CASTS.items()))
