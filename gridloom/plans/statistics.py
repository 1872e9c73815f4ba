"""Queries over statistics, time windows and graphs."""

from pyspark.sql import functions as F

from gridloom.functions import statistics as S
from gridloom.registry import query
from gridloom.streaming import windows as T


@query("higher_moments", """
SELECT l_returnflag, round(skewness(l_extendedprice), 4) AS skew, round(kurtosis(l_extendedprice), 4) AS kurt, round(geometric_mean(l_quantity), 4) AS geo, round(count(*) / sum(1 / l_quantity), 4) AS harm, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 4) AS iqr, round(stddev_samp(l_quantity) / avg(l_quantity), 4) AS cv, round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS se FROM lineitem GROUP BY 1""")
def _(t):
    made = {"skew": S.skewness("l_extendedprice"), "kurt": S.kurtosis("l_extendedprice"), "geo": S.geometric_mean("l_quantity"), "harm": S.harmonic_mean("l_quantity"), "cv": S.variation("l_quantity")}
    moments = t("lineitem").groupBy("l_returnflag").agg(*(F.round(c, 4).alias(n) for n, c in made.items()), F.round(S.standard_error("l_quantity"), 6).alias("se"))
    return moments.join(S.iqr(t("lineitem"), "l_quantity", ["l_returnflag"]).withColumn("iqr", F.round("iqr", 4)), "l_returnflag")


@query("trimmed_mean", "WITH e AS (SELECT quantile_cont(l_extendedprice, 0.1) AS a, quantile_cont(l_extendedprice, 0.9) AS b FROM lineitem) SELECT round(avg(l_extendedprice), 4) AS trimmed_mean FROM lineitem, e WHERE l_extendedprice BETWEEN a AND b")
def _(t):
    return S.trimmed_mean(t("lineitem"), "l_extendedprice", 0.1).select(F.round("trimmed_mean", 4).alias("trimmed_mean"))


@query("regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 5) AS r2 FROM lineitem")
def _(t):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return t("lineitem").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 5).alias("r2"))


@query("welch_t", """
WITH s AS (SELECT l_returnflag g, avg(l_quantity) m, var_samp(l_quantity) / count(*) v, count(*) n FROM lineitem GROUP BY 1)
SELECT round((a.m - b.m) / sqrt(a.v + b.v), 4) AS t, round(pow(a.v + b.v, 2) / (a.v * a.v / (a.n - 1) + b.v * b.v / (b.n - 1)), 2) AS dof FROM s a, s b WHERE a.g = 'A' AND b.g = 'N'""")
def _(t):
    return S.welch_t(t("lineitem"), "l_quantity", "l_returnflag", "A", "N").select(F.round("t", 4).alias("t"), F.round("dof", 2).alias("dof"))


@query("anova", """
WITH g AS (SELECT count(*) n, avg(o_totalprice) m, var_pop(o_totalprice) * count(*) w FROM orders GROUP BY o_orderpriority)
SELECT round(((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 4) AS f FROM g""")
def _(t):
    return S.anova_f(t("orders"), "o_totalprice", "o_orderpriority").select(F.round("f", 4).alias("f"))


@query("chi_square", """
WITH n AS (SELECT o_orderstatus a, o_orderpriority b, count(*) o FROM orders GROUP BY ALL), r AS (SELECT a, sum(o) r FROM n GROUP BY 1), c AS (SELECT b, sum(o) c FROM n GROUP BY 1), t AS (SELECT sum(o) t FROM n)
SELECT round(sum(pow(coalesce(o, 0) - r * c / t, 2) / (r * c / t)), 4) AS chi2, (count(DISTINCT r.a) - 1) * (count(DISTINCT c.b) - 1) AS dof FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN n ON n.a = r.a AND n.b = c.b""")
def _(t):
    return S.chi_square(t("orders"), "o_orderstatus", "o_orderpriority").select(F.round("chi2", 4).alias("chi2"), "dof")


@query("tumbling_day", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t):
    return T.tumbling(t("events"), "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("sessions", """
WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT * FROM m ORDER BY user_id, ts, fresh DESC))
SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1""")
def _(t):
    return T.sessions(t("events"), "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("last_n_events", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 25")
def _(t):
    return T.last_n(t("events"), 25).select("event_id")


@query("degree_parts", "SELECT p, count(DISTINCT q) AS degree FROM (SELECT l_suppkey AS p, l_partkey AS q FROM lineitem) GROUP BY 1")
def _(t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("p")).agg(F.count_distinct("l_partkey").alias("degree"))
