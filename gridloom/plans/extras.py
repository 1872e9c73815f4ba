"""Queries over distributions, signals, neighbours, components, folds, and further measures."""

from pyspark.sql import functions as F

from gridloom.functions import distributions as D
from gridloom.functions import finance, signals
from gridloom.functions import statistics as S
from gridloom.operators import learning, neighbours, scans
from gridloom.operators.windows import ordered
from gridloom.registry import query
from gridloom.streaming import filters


@query("chi_square_p", """
WITH n AS (SELECT o_orderstatus a, o_orderpriority b, count(*)::DOUBLE o FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(o) r FROM n GROUP BY 1), c AS (SELECT b, sum(o) c FROM n GROUP BY 1), t AS (SELECT sum(o) t FROM n),
s AS (SELECT sum(pow(coalesce(o, 0) - r * c / t, 2) / (r * c / t)) AS x, (count(DISTINCT r.a) - 1) * (count(DISTINCT c.b) - 1) AS dof FROM r, c, t LEFT JOIN n ON n.a = r.a AND n.b = c.b)
SELECT round(x, 6) AS chi2, dof, round(exp(-x / 2) * list_sum(list_transform(range(dof // 2), lambda i: pow(x / 2, i) / factorial(i::INTEGER))), 9) AS p FROM s""")
def _(t):
    s = S.chi_square(t("orders"), "o_orderstatus", "o_orderpriority")
    return s.select(F.round("chi2", 6).alias("chi2"), "dof", F.round(D.above("chi2", F.col("chi2"), F.col("dof")), 9).alias("p"))


@query("chi2_two_degrees", "SELECT p_partkey, round(1 - exp(-p_size / 2.0), 9) AS p FROM part")
def _(t):
    return t("part").select("p_partkey", F.round(D.cdf("chi2", F.col("p_size"), 2), 9).alias("p"))


@query("beta_cdf", "SELECT p_partkey, round(pow(p_size / 50.0, 2) * (3 - 2 * p_size / 50.0), 9) AS p FROM part")
def _(t):
    return t("part").select("p_partkey", F.round(D.cdf("beta", F.col("p_size") / 50.0, 2, 2), 9).alias("p"))


@query("poisson_cdf", "SELECT p_partkey, round((SELECT sum(exp(-4.0) * pow(4.0, i) / factorial(i::INTEGER)) FROM range(11) r(i) WHERE i <= p_size % 11), 9) AS p FROM part")
def _(t):
    return t("part").select("p_partkey", F.round(D.cdf("poisson", F.col("p_size") % 11, 4.0), 9).alias("p"))


@query("exponential_cdf", "SELECT event_id, round(1 - exp(-0.02 * greatest(value, 0)), 9) AS p FROM events")
def _(t):
    return t("events").select("event_id", F.round(D.cdf("exponential", F.col("value"), 0.02), 9).alias("p"))


@query("fir_filter", "SELECT event_id, round(0.5 * value + 0.3 * coalesce(lag(value) OVER w, 0) + 0.2 * coalesce(lag(value, 2) OVER w, 0), 6) AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    return t("events").select("event_id", F.round(signals.fir("value", [0.5, 0.3, 0.2], ordered(["user_id"], ["ts", "event_id"])), 6).alias("y"))


@query("savitzky_golay", "SELECT event_id, round((-3 * lag(value, 2) OVER w + 12 * lag(value) OVER w + 17 * value + 12 * lead(value) OVER w - 3 * lead(value, 2) OVER w) / 35, 6) AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    return t("events").select("event_id", F.round(signals.centred("value", signals.smoothing_taps(5, 2), ordered(["user_id"], ["ts", "event_id"])), 6).alias("y"))


@query("zero_crossings", "SELECT event_type, count(*) AS n FROM (SELECT event_type, (value - 50 < 0) <> (lag(value - 50) OVER (PARTITION BY event_type ORDER BY ts, event_id) < 0) AS x FROM events) WHERE x GROUP BY 1")
def _(t):
    df = t("events").withColumn("v", F.col("value") - 50)
    return scans.framed(df, {"x": lambda w: signals.crosses_zero("v", w)}, ["event_type"], ["ts", "event_id"], before=1).where("x").groupBy("event_type").agg(F.count("*").alias("n"))


@query("autocorrelation", """
WITH v AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS x, ts, event_id FROM events), p AS (SELECT event_type, x, lag(x, 2) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS y FROM v)
SELECT event_type, round(sum(x * y) / sum(x * x), 6) AS autocorrelation FROM p GROUP BY 1""")
def _(t):
    return signals.autocorrelation(t("events"), "value", ["event_type"], ["ts", "event_id"], 2).withColumn("autocorrelation", F.round("autocorrelation", 6))


@query("spectrum", """
WITH v AS (SELECT user_id, value, -2 * pi() * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / count(*) OVER (PARTITION BY user_id) AS t FROM events)
SELECT user_id, CAST(k AS INTEGER) AS bin, round(pow(sum(value * cos(t * k)), 2) + pow(sum(value * sin(t * k)), 2), 2) AS power FROM v, range(4) r(k) GROUP BY 1, 2""")
def _(t):
    return signals.spectrum(t("events"), "value", ["user_id"], ["ts", "event_id"], 4).select("user_id", "bin", F.round("power", 2).alias("power"))


@query("convolution", """
WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT user_id, CAST(i + j AS INTEGER) AS at, round(sum(value * (j + 1)), 6) AS y FROM v, range(3) r(j) GROUP BY 1, 2""")
def _(t):
    return signals.convolve(t("events"), "value", ["user_id"], ["ts", "event_id"], [1.0, 2.0, 3.0]).withColumn("y", F.round("y", 6))


@query("nearest_customers", """
SELECT q.c_custkey AS query, n.c_custkey AS neighbour, row_number() OVER (PARTITION BY q.c_custkey ORDER BY pow(q.c_acctbal - n.c_acctbal, 2) + pow(q.c_nationkey - n.c_nationkey, 2), n.c_custkey) AS rank
FROM customer q, customer n WHERE q.c_custkey % 20 = 0 AND n.c_custkey <> q.c_custkey QUALIFY rank <= 5""")
def _(t):
    c = t("customer")
    return neighbours.nearest(c.where("c_custkey % 20 = 0"), c, "c_custkey", ["c_acctbal", "c_nationkey"], 5).select("query", "neighbour", "rank")


@query("kernel_density", "SELECT x::DOUBLE AS x, round(avg(exp(-pow((value - x) / 5.0, 2) / 2) / (5.0 * sqrt(2 * pi()))), 9) AS density FROM events, (VALUES (10), (50), (90)) p(x) GROUP BY 1")
def _(t):
    return neighbours.density(t("events"), "value", [10, 50, 90], 5.0).withColumn("density", F.round("density", 9))


@query("min_max", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS c_acctbal FROM customer")
def _(t):
    return learning.min_max(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("yeo_johnson", "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN 2 * (sqrt(c_acctbal + 1) - 1) ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END, 4) AS v FROM customer")
def _(t):
    return t("customer").select("c_custkey", F.round(learning.yeo_johnson(F.col("c_acctbal"), 0.5), 4).alias("v"))


@query("mutual_information", """
WITH n AS (SELECT o_orderpriority x, o_orderstatus y, count(*)::DOUBLE n FROM orders GROUP BY 1, 2), m AS (SELECT n, sum(n) OVER () t, sum(n) OVER (PARTITION BY x) a, sum(n) OVER (PARTITION BY y) b FROM n)
SELECT 'o_orderpriority' AS "column", round(sum(n / t * ln(n * t / (a * b))), 9) AS information FROM m""")
def _(t):
    return learning.mutual_information(t("orders"), ["o_orderpriority"], "o_orderstatus").withColumn("information", F.round("information", 9))


@query("score_measures", """
WITH p AS (SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, least(greatest(value / 200, 0.01), 0.99) AS p, value > 50 AS s FROM events)
SELECT round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss, round(avg(pow(p - y, 2)), 6) AS brier, round(corr(y, CASE WHEN s THEN 1 ELSE 0 END), 6) AS matthews FROM p""")
def _(t):
    df = t("events").select((F.col("event_type") == "purchase").cast("int").alias("y"), F.least(F.greatest(F.col("value") / 200, F.lit(0.01)), F.lit(0.99)).alias("p"), (F.col("value") > 50).alias("s"))
    made = {"log_loss": learning.log_loss("y", "p"), "brier": learning.brier("y", "p"), "matthews": learning.matthews(F.col("y") == 1, F.col("s"))}
    return df.agg(*(F.round(c, 6).alias(n) for n, c in made.items()))


@query("kappa", """
WITH p AS (SELECT event_type = 'purchase' AS y, value > 50 AS p FROM events), s AS (SELECT avg((y = p)::INT) AS o, avg(y::INT) * avg(p::INT) + (1 - avg(y::INT)) * (1 - avg(p::INT)) AS e FROM p)
SELECT round((o - e) / (1 - e), 6) AS kappa FROM s""")
def _(t):
    df = t("events").select((F.col("event_type") == "purchase").alias("y"), (F.col("value") > 50).alias("p"))
    return learning.kappa(df, "y", "p").withColumn("kappa", F.round("kappa", 6))


@query("ndcg", """
WITH g AS (SELECT l_suppkey, l_linenumber % 4 AS g, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber % 4 DESC, l_orderkey * 10 + l_linenumber) AS i FROM lineitem)
SELECT l_suppkey, round(sum(CASE WHEN a <= 10 THEN (pow(2, g) - 1) / log2(a + 1) ELSE 0 END) / sum(CASE WHEN i <= 10 THEN (pow(2, g) - 1) / log2(i + 1) ELSE 0 END), 6) AS ndcg FROM g GROUP BY 1""")
def _(t):
    df = t("lineitem").select("l_suppkey", "l_extendedprice", (F.col("l_linenumber") % 4).alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return learning.ndcg(df, ["l_suppkey"], "g", "l_extendedprice", "tie", 10).withColumn("ndcg", F.round("ndcg", 6))


@query("cross_validation", """
WITH d AS (SELECT ('0x' || substr(md5('0:' || (l_orderkey * 10 + l_linenumber)), 1, 15))::BIGINT % 3 AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem), k AS (SELECT unnest([0, 1, 2]) AS k),
m AS (SELECT k, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM d, k WHERE fold <> k GROUP BY 1)
SELECT CAST(k AS INTEGER) AS fold, round(avg(pow(y - s * x - i, 2)), 0) AS mse, round(sqrt(avg(pow(y - s * x - i, 2))), 3) AS rmse, round(avg(abs(y - s * x - i)), 3) AS mae, round(1 - avg(pow(y - s * x - i, 2)) / var_pop(y), 6) AS r2 FROM d JOIN m ON fold = k GROUP BY 1""")
def _(t):
    df = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice")
    return learning.cross_validate(df, "linear", ["l_quantity"], "l_extendedprice", "id", 3, learning.regression_measures("l_extendedprice", "prediction")).select("fold", *(F.round(c, d).alias(c) for c, d in (("mse", 0), ("rmse", 3), ("mae", 3), ("r2", 6))))


@query("false_discoveries", """
WITH p AS (SELECT s_suppkey, (s_suppkey * 37 % 1000) / 1000.0::DOUBLE AS p FROM supplier), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, s_suppkey) AS q FROM p)
SELECT s_suppkey, round(least(1.0, min(q) OVER (ORDER BY p, s_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS adjusted FROM r""")
def _(t):
    df = t("supplier").select("s_suppkey", ((F.col("s_suppkey") * 37 % 1000) / 1000.0).alias("p"))
    return S.benjamini_hochberg(df, "s_suppkey", "p").select("s_suppkey", F.round("adjusted", 9).alias("adjusted"))


@query("paired_t", "SELECT round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) AS t FROM lineitem")
def _(t):
    return t("lineitem").agg(F.round(S.paired_t("l_discount", "l_tax"), 6).alias("t"))


@query("goodness_of_fit", "WITH n AS (SELECT c_mktsegment, count(*)::DOUBLE o FROM customer GROUP BY 1) SELECT round(sum(pow(o - e, 2) / e), 6) AS chi2, count(*) - 1 AS dof FROM (SELECT o, sum(o) OVER () / 5 AS e FROM n)")
def _(t):
    s = S.goodness_of_fit(t("customer"), "c_mktsegment", {k: 0.2 for k in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")})
    return s.withColumn("chi2", F.round("chi2", 6))


@query("equal_spread", """
WITH z AS (SELECT g, abs(v - median(v) OVER (PARTITION BY g)) AS z FROM (SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem)), s AS (SELECT g, avg(z) m, var_pop(z) * count(*) w, count(*) n FROM z GROUP BY 1)
SELECT round((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))), 6) AS f FROM s""")
def _(t):
    return S.brown_forsythe(t("lineitem"), "l_extendedprice", "l_returnflag").select(F.round("f", 6).alias("f"))


@query("bootstrap_mean")
def _(t):
    return S.bootstrap_mean(t("customer"), "c_acctbal", "c_custkey", 100)


@query("internal_rates", """
WITH RECURSIVE f AS (SELECT o_orderpriority AS p, o_custkey % 12 AS t, sum(CASE WHEN o_custkey % 12 = 0 THEN -8 * o_totalprice ELSE o_totalprice END) AS f FROM orders GROUP BY 1, 2), l AS (SELECT p, list({'t': t, 'f': f}) AS l FROM f GROUP BY 1),
r AS (SELECT 0 AS i, p, l, -0.9::DOUBLE AS lo, 10.0::DOUBLE AS hi FROM l UNION ALL SELECT i + 1, p, l, CASE WHEN v > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN v > 0 THEN hi ELSE (lo + hi) / 2 END
FROM (SELECT *, list_sum(list_transform(l, lambda x: x.f / pow(1 + (lo + hi) / 2, x.t))) AS v FROM r WHERE i < 60))
SELECT p AS o_orderpriority, round((lo + hi) / 2, 6) AS rate FROM r WHERE i = 60""")
def _(t):
    df = t("orders").select("o_orderpriority", (F.col("o_custkey") % 12).alias("period"), F.when(F.col("o_custkey") % 12 == 0, -8 * F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("flow"))
    return finance.internal_rate(df, ["o_orderpriority"], "flow", "period").withColumn("rate", F.round("rate", 6))


@query("expected_shortfall", "SELECT round(-avg(c_acctbal), 4) AS shortfall FROM customer WHERE c_acctbal <= (SELECT quantile_cont(c_acctbal, 0.05) FROM customer)")
def _(t):
    return finance.shortfall(t("customer"), "c_acctbal").withColumn("shortfall", F.round("shortfall", 4))


@query("market_beta", "SELECT l_returnflag, round(covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity), 6) AS beta FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(finance.beta("l_extendedprice", "l_quantity"), 6).alias("beta"))


@query("bond_prices", "SELECT p_partkey, round(p_retailprice * 0.04 * (1 - pow(1.05, -p_size)) / 0.05 + p_retailprice / pow(1.05, p_size), 6) AS price FROM part")
def _(t):
    return t("part").select("p_partkey", F.round(finance.bond_price(F.col("p_retailprice"), F.lit(0.04), F.lit(0.05), F.col("p_size")), 6).alias("price"))


@query("kalman_events", """
WITH e AS (SELECT event_type, event_id, list({'m': value::DOUBLE, 'v': 1.0::DOUBLE, 'x': value::DOUBLE}) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS l FROM events),
s AS (SELECT event_type, event_id, list_reduce(l, lambda a, e: {'m': a.m + (a.v + 0.01) / (a.v + 1.01) * (e.x - a.m), 'v': (a.v + 0.01) / (a.v + 1.01), 'x': e.x}) AS s FROM e)
SELECT event_type, event_id, round(s.m, 6) AS estimate, round(s.v, 6) AS variance FROM s""")
def _(t):
    made = filters.kalman(t("events"))
    return made.select(F.col("key").alias("event_type"), F.col("id").alias("event_id"), F.round("estimate", 6).alias("estimate"), F.round("variance", 6).alias("variance"))
