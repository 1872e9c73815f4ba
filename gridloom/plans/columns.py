"""Queries over columns: arithmetic, casts, text, dates, vectors, money, encoding."""

from pyspark.sql import functions as F

from gridloom.functions import finance, text, vectors
from gridloom.operators import frame
from gridloom.registry import query


@query("filter_project", "SELECT l_orderkey, l_quantity * l_tax AS q FROM lineitem WHERE l_quantity > 30 AND l_returnflag <> 'N'")
def _(t):
    return t("lineitem").where((F.col("l_quantity") > 30) & (F.col("l_returnflag") != "N")).select("l_orderkey", (F.col("l_quantity") * F.col("l_tax")).alias("q"))


@query("arithmetic", "SELECT o_orderkey, round(o_totalprice + 1, 4) AS a, round(o_totalprice - 1, 4) AS s, round(o_totalprice * 2, 4) AS m, o_totalprice / nullif(o_custkey - 5, 0) AS d, round(abs(-o_totalprice), 4) AS n FROM orders")
def _(t):
    p = F.col("o_totalprice")
    made = {"a": p + 1, "s": p - 1, "m": p * 2, "d": F.try_divide(p, F.col("o_custkey") - 5), "n": F.abs(-p)}
    return t("orders").select("o_orderkey", *((c if n == "d" else F.round(c, 4)).alias(n) for n, c in made.items()))


@query("cast_matrix", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_custkey AS VARCHAR) AS txt, o_orderstatus <> '' AS flag, CAST(o_orderdate AS DATE) AS d FROM orders")
def _(t):
    return t("orders").select("o_orderkey", frame.to_integer(F.col("o_totalprice")).alias("whole"), F.col("o_custkey").cast("string").alias("txt"), (F.col("o_orderstatus") != "").alias("flag"), F.col("o_orderdate").cast("date").alias("d"))


@query("string_ops", """
SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS up, replace(p_brand, '#', '-') AS rep, contains(p_type, 'STEEL') AS has, starts_with(p_type, 'SMALL') AS st, ends_with(p_type, 'TIN') AS en, strlen(p_name) AS len, lpad(p_brand, CAST(greatest(12, strlen(p_brand)) AS INTEGER), '.') AS pad, nullif(split_part(p_type, ' ', 2), '') AS second FROM part""")
def _(t):
    return t("part").select(
        "p_partkey", F.lower("p_name").alias("low"), F.upper("p_name").alias("up"), text.replace(F.col("p_brand"), "#", "-").alias("rep"), text.contains("p_type", "STEEL").alias("has"),
        F.col("p_type").startswith("SMALL").alias("st"), F.col("p_type").endswith("TIN").alias("en"), text.byte_length(F.col("p_name")).cast("long").alias("len"),
        text.pad_left(F.col("p_brand"), 12, ".").alias("pad"), text.piece(F.col("p_type"), " ", 1).alias("second"),
    )


@query("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dow, CAST(hour(o_orderdate) AS INTEGER) AS o_orderdate_hour FROM orders")
def _(t):
    return t("orders").select("o_orderkey", *text.date_parts("o_orderdate", ["year", "month", "day", "dow", "hour"]))


@query("null_ops", "SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN value END, -1.0) AS filled FROM events WHERE event_id % 5 <> 0")
def _(t):
    df = t("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("filled"), F.when(F.col("event_id") % 5 != 0, F.lit(1)).alias("k"))
    return df.na.drop(subset=["k"]).na.fill(-1.0, ["filled"]).select("event_id", "filled")


@query("one_hot_mktsegment", "SELECT c_custkey, " + ", ".join(f"c_mktsegment = '{v}' AS c_mktsegment_{v}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def _(t):
    return frame.one_hot_encode(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query("category_codes", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS c_mktsegment_code FROM customer")
def _(t):
    return frame.category_codes(t("customer"), "c_mktsegment").select("c_custkey", "c_mktsegment_code")


@query("profile_customer", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) AS skew FROM customer" for c in ("c_custkey", "c_nationkey", "c_acctbal")))
def _(t):
    out = frame.profile(t("customer"))
    return out.select("column", "count", "null_count", "unique_count", *(F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std", "skew")))


@query("dot_product", "SELECT c_custkey, round(c_acctbal * 2.0 + c_nationkey * 0.5, 4) AS col_0, round(c_acctbal * -1.0, 4) AS col_1 FROM customer")
def _(t):
    out = frame.dot(t("customer"), ["c_custkey"], ["c_acctbal", "c_nationkey"], [[2.0, -1.0], [0.5, 0.0]])
    return out.select("c_custkey", F.round("col_0", 4).alias("col_0"), F.round("col_1", 4).alias("col_1"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 5) AS l1 FROM embeddings")
def _(t):
    e = F.col("embedding")
    zero = F.transform(e, lambda x: F.lit(0.0))
    return t("embeddings").select("vec_id", F.round(vectors.norm(e), 5).alias("norm"), F.round(vectors.manhattan(e, zero), 5).alias("l1"))


@query("cosine_to_first", "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 5) AS cos FROM embeddings e, embeddings f WHERE f.vec_id = 0")
def _(t):
    one = t("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return t("embeddings").join(F.broadcast(one)).select("vec_id", F.round(vectors.cosine_similarity(F.col("embedding"), F.col("q")), 5).alias("cos"))


@query("annuity", "SELECT s_suppkey, round(abs(s_acctbal) * 0.01 / (1 - pow(1.01, -12)), 4) AS pay, round(s_acctbal * pow(1.05, 3), 4) AS fv FROM supplier")
def _(t):
    lit = F.lit
    return t("supplier").select("s_suppkey", F.round(finance.payment(F.abs("s_acctbal"), lit(0.01), lit(12)), 4).alias("pay"), F.round(finance.future_value(F.col("s_acctbal"), lit(0.05), lit(3)), 4).alias("fv"))
