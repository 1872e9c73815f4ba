"""Queries over aggregates."""

from pyspark.sql import functions as F

from gridloom.operators import aggregate as A
from gridloom.operators import running
from gridloom.registry import query


@query("revenue_by_flag", """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue_sum, round(avg(l_extendedprice * (1 - l_discount)), 4) AS revenue_mean, count(*) AS revenue_count
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def _(t):
    df = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("revenue"), 2).alias("revenue_sum"), F.round(F.avg("revenue"), 4).alias("revenue_mean"), F.count("*").alias("revenue_count")).orderBy("l_returnflag", "l_linestatus")


OPS = {"sum": "CAST(sum({c}) AS DOUBLE)", "mean": "avg({c})", "count": "count({c})", "min": "CAST(min({c}) AS DOUBLE)", "max": "CAST(max({c}) AS DOUBLE)", "median": "CAST(median({c}) AS DOUBLE)", "std": "stddev_samp({c})", "var": "var_samp({c})", "nunique": "count(DISTINCT {c})"}
for op, sql in OPS.items():
    rounded = (lambda x: x) if op in ("count", "nunique") else (lambda x: f"round({x}, 4)")

    @query(f"group_{op}", f"SELECT l_returnflag, {rounded(sql.format(c='l_quantity'))} AS l_quantity_{op}, {rounded(sql.format(c='l_extendedprice'))} AS l_extendedprice_{op} FROM lineitem GROUP BY 1")
    def _(t, op=op):
        out = A.group_by(t("lineitem"), ["l_returnflag"], op, ["l_quantity", "l_extendedprice"])
        return out if op in ("count", "nunique") else out.select("l_returnflag", *(F.round(c, 4).alias(c) for c in out.columns[1:]))


for op, f in (("first", "arg_min"), ("last", "arg_max")):
    @query(f"group_{op}", f"SELECT event_type, {f}(value, event_id) AS value_{op} FROM events WHERE value IS NOT NULL GROUP BY 1")
    def _(t, op=op):
        return A.group_by(t("events"), ["event_type"], op, ["value"], order="event_id")


@query("group_transform", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS o_totalprice_mean FROM orders")
def _(t):
    return A.transform(t("orders"), ["o_orderpriority"], "mean", ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice_mean", 4).alias("o_totalprice_mean"))


@query("pivot_status_priority", """
SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS "o_orderstatus=F", round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS "o_orderstatus=O", round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS "o_orderstatus=P"
FROM orders GROUP BY 1""")
def _(t):
    out = A.pivot_table(t("orders"), "o_totalprice", "o_orderpriority", "o_orderstatus", "mean", ["F", "O", "P"])
    return out.select(out.columns[0], *(F.round(f"`{c}`", 4).alias(c) for c in out.columns[1:]))


@query("resample_events_7d", "SELECT CAST(floor(epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) / 86400 / 7) AS BIGINT) AS bucket, round(CAST(sum(value) AS DOUBLE), 4) AS value FROM events GROUP BY 1")
def _(t):
    return A.resample(t("events"), "ts", 7, ["value"]).select("bucket", F.round("value", 4).alias("value"))


_STATS = [("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"), *((f"{q * 100:g}%", f"quantile_cont({{c}}, {q})") for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)), ("max", "max({c})")]


@query("describe_lineitem", " UNION ALL ".join(f"SELECT '{n}' AS statistic, " + ", ".join(f"round({x.format(c=c)}, 4) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem" for n, x in _STATS))
def _(t):
    out = A.describe(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("statistic", *(F.round(c, 4).alias(c) for c in out.columns[1:]))


@query("quantiles_by_flag", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1")
def _(t):
    found = running.quantiles(t("lineitem"), ["l_extendedprice"], [0.05, 0.5, 0.99], ["l_returnflag"])
    at = lambda q: F.round(F.max(F.when(F.col("share") == q, F.col("value"))), 4)
    return found.groupBy("l_returnflag").agg(at(0.05).alias("p05"), at(0.5).alias("p50"), at(0.99).alias("p99"))


_C = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
for name, f, sql in (("corr", A.correlations, "corr"), ("cov", A.covariances, "covar_samp")):
    @query(f"{name}_lineitem", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({sql}({a}, {b}), 5) AS {name} FROM lineitem" for i, a in enumerate(_C) for b in _C[i + 1 :]))
    def _(t, f=f, name=name):
        return f(t("lineitem"), list(_C)).select("a", "b", F.round(name, 5).alias(name))


@query("weighted_mean", "SELECT l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS price FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_linestatus").agg(F.round(A.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("price"))


@query("value_counts_segment", 'SELECT c_mktsegment, count(*) AS "count" FROM customer GROUP BY 1')
def _(t):
    return A.value_counts(t("customer"), "c_mktsegment")


@query("mode_size", 'SELECT p_size, count(*) AS "count" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1')
def _(t):
    return A.mode(t("part"), "p_size")


@query("histogram_price", """
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS "count" FROM lineitem, e GROUP BY 1""")
def _(t):
    return A.histogram(t("lineitem"), "l_extendedprice", 20)


@query("cube_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
