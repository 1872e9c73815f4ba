"""Queries over ranks of whole columns, graphs, models and their measures."""

from pyspark.sql import functions as F

from gridloom.functions import finance
from gridloom.functions import statistics as S
from gridloom.operators import graphs, learning, running
from gridloom.registry import query

#: The normal distribution function in SQL, by its series: exact to rounding for numbers within about 8 of 0.
PHI = "(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * CASE WHEN ({x}) = 0 THEN 0 ELSE sign({x}) * list_sum(list_transform(range(120), lambda i: exp((2 * i + 1) * ln(abs({x})) + i * ln(2.0) + lgamma(i + 1.0) - lgamma(2 * i + 2.0)))) END)"

_TWO = "(SELECT l_extendedprice AS v, l_returnflag AS g FROM lineitem WHERE l_returnflag IN ('A', 'R'))"


@query("kolmogorov_smirnov", f"""
WITH n AS (SELECT v, count(*) FILTER (g = 'A') AS a, count(*) FILTER (g = 'R') AS b FROM {_TWO} GROUP BY 1)
SELECT round(max(abs(x)), 8) AS d FROM (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS x FROM n)""")
def _(t):
    return running.kolmogorov_smirnov(t("lineitem"), "l_extendedprice", "l_returnflag", "A", "R").select(F.round("d", 8).alias("d"))


@query("mann_whitney", f"""
WITH r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS k FROM {_TWO}), s AS (SELECT sum(k) FILTER (g = 'A') AS w, CAST(count(*) FILTER (g = 'A') AS DOUBLE) AS a, CAST(count(*) FILTER (g = 'R') AS DOUBLE) AS b FROM r)
SELECT round(w - a * (a + 1) / 2, 1) AS u, round((w - a * (a + 1) / 2 - a * b / 2) / sqrt(a * b * (a + b + 1) / 12), 6) AS z FROM s""")
def _(t):
    return running.mann_whitney(t("lineitem"), "l_extendedprice", "l_returnflag", "A", "R").select(F.round("u", 1).alias("u"), F.round("z", 6).alias("z"))


@query("spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS y FROM lineitem)
SELECT round(corr(x, y), 6) AS rho FROM r""")
def _(t):
    return running.spearman(t("lineitem"), "l_quantity", "l_extendedprice").select(F.round("rho", 6).alias("rho"))


@query("winsorized_mean", "WITH e AS (SELECT quantile_cont(o_totalprice, 0.1) AS a, quantile_cont(o_totalprice, 0.9) AS b FROM orders) SELECT round(avg(least(greatest(o_totalprice, a), b)), 4) AS winsorized_mean FROM orders, e")
def _(t):
    return S.winsorized_mean(t("orders"), "o_totalprice", 0.1).select(F.round("winsorized_mean", 4).alias("winsorized_mean"))


@query("median_deviation", "SELECT round(mad(o_totalprice), 4) AS mad FROM orders")
def _(t):
    return S.median_deviation(t("orders"), "o_totalprice").select(F.round("mad", 4).alias("mad"))


@query("weighted_variance", "SELECT round((sum(l_quantity * l_tax * l_tax) - pow(sum(l_quantity * l_tax), 2) / sum(l_quantity)) / (sum(l_quantity) - 1), 8) AS v, round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 6) AS t FROM lineitem")
def _(t):
    return t("lineitem").agg(F.round(S.weighted_variance("l_tax", "l_quantity"), 8).alias("v"), F.round(S.one_sample_t("l_quantity", 25.0), 6).alias("t"))


@query("cohens_d", """
WITH s AS (SELECT l_returnflag g, avg(l_quantity) m, var_samp(l_quantity) v, count(*) n FROM lineitem GROUP BY 1)
SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS d FROM s a, s b WHERE a.g = 'A' AND b.g = 'N'""")
def _(t):
    return S.cohens_d(t("lineitem"), "l_quantity", "l_returnflag", "A", "N").select(F.round("d", 6).alias("d"))


@query("log_gamma", "SELECT p_partkey, round(lgamma(p_size), 6) AS g FROM part")
def _(t):
    return t("part").select("p_partkey", F.round(S.special("lgamma", F.col("p_size").cast("double")), 6).alias("g"))


@query("net_present_value", "SELECT o_orderpriority, round(sum(o_totalprice / pow(1.01, o_custkey % 24)), 2) AS npv FROM orders GROUP BY 1")
def _(t):
    return t("orders").withColumn("period", F.col("o_custkey") % 24).groupBy("o_orderpriority").agg(F.round(finance.net_present_value("o_totalprice", "period", 0.01), 2).alias("npv"))


_D1, _D2 = "((ln(p_retailprice / 1000.0) + 0.05) / 0.2)", "((ln(p_retailprice / 1000.0) + 0.01) / 0.2)"


@query("call_prices", f"SELECT p_partkey, round(p_retailprice * {PHI.format(x=_D1)} - 1000 * exp(-0.03) * {PHI.format(x=_D2)}, 4) AS price FROM part")
def _(t):
    lit = F.lit
    return t("part").select("p_partkey", F.round(finance.black_scholes_call(F.col("p_retailprice"), lit(1000.0), lit(0.03), lit(0.2), lit(1.0)), 4).alias("price"))


@query("rollup_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(t):
    return t("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("cube_means", "SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


def _tradings(t):
    """Suppliers and parts that meet in a line."""
    return t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))


def _places(t, directed: bool = False):
    """Nations, customers and orders as whole numbers (three times the key, and 0, 1 or 2): each order with its customer, each
    customer with its nation, and the orders of every fifth nation with that nation too."""
    customer, order = t("customer").select("c_custkey", "c_nationkey"), t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    n, c, o = 3 * F.col("c_nationkey"), 3 * F.col("c_custkey") + 1, 3 * F.col("o_orderkey") + 2
    far = order.join(customer, "c_custkey").where("c_nationkey % 5 = 0")
    parts = [customer.select(n.alias("a"), c.alias("b")), order.select(c.alias("a"), o.alias("b")), far.select(n.alias("a"), o.alias("b"))]
    return parts[0].union(parts[1]).union(parts[2]).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


_PLACES = """(SELECT 3 * c_nationkey AS a, 3 * c_custkey + 1 AS b FROM customer UNION ALL SELECT 3 * o_custkey + 1, 3 * o_orderkey + 2 FROM orders
UNION ALL SELECT 3 * c_nationkey, 3 * o_orderkey + 2 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 = 0)"""
_BOTH = f"(SELECT a, b FROM {_PLACES} UNION SELECT b, a FROM {_PLACES})"
#: Each nation's tree: its customers and their orders, and the smallest number among them.
_TREES = "(SELECT c_nationkey AS n, least(3 * c_nationkey, min(3 * c_custkey + 1), min(3 * o_orderkey + 2)) AS component, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"


@query("graph_degrees", f"SELECT a AS node, count(*) AS degree FROM {_BOTH} GROUP BY 1")
def _(t):
    return graphs.degrees(_places(t))


@query("graph_components", f"""
SELECT 3 * n AS node, component FROM {_TREES} UNION ALL SELECT 3 * c_custkey + 1, component FROM customer JOIN {_TREES} ON n = c_nationkey
UNION ALL SELECT 3 * o_orderkey + 2, component FROM orders JOIN customer ON o_custkey = c_custkey JOIN {_TREES} ON n = c_nationkey""")
def _(t):
    return graphs.connected_components(_places(t))


@query("graph_cycles", f"SELECT nodes, edges, components, edges - nodes + components AS cycles FROM (SELECT count(DISTINCT a) AS nodes FROM {_BOTH}), (SELECT count(*) AS edges FROM {_PLACES}), (SELECT count(*) AS components FROM {_TREES})")
def _(t):
    return graphs.cycles(_places(t))


@query("graph_bipartite", f"SELECT component, NOT (n % 5 = 0 AND orders > 0) AS bipartite FROM {_TREES}")
def _(t):
    return graphs.bipartite(_places(t))


@query("graph_spanning_forest", f"SELECT least(a, b) AS a, greatest(a, b) AS b, ((a + b) % 97)::DOUBLE AS w FROM {_PLACES} WHERE NOT (a % 3 = 0 AND b % 3 = 2)")
def _(t):
    far = (F.col("a") % 3 == 0) & (F.col("b") % 3 == 2)
    return graphs.spanning_forest(_places(t).withColumn("w", (F.col("a") + F.col("b")) % 97 + F.when(far, 1000).otherwise(0)))


@query("graph_levels", f"SELECT 3 * n AS node, 0 AS level FROM {_TREES} UNION ALL SELECT 3 * c_custkey + 1, 1 FROM customer UNION ALL SELECT 3 * o_orderkey + 2, 2 FROM orders")
def _(t):
    return graphs.topological_levels(_places(t))


@query("graph_shortest_paths", """
WITH c AS (SELECT c_custkey, c_custkey % 7 + 1.0::DOUBLE AS cost FROM customer WHERE c_nationkey = 0), o AS (SELECT o_orderkey, o_custkey, cost + o_orderkey % 5 - 0.5 AS by_customer, 6.0::DOUBLE + o_orderkey % 3 AS direct FROM orders JOIN c ON o_custkey = c_custkey)
SELECT 0 AS node, 0.0::DOUBLE AS cost, NULL::BIGINT AS via UNION ALL SELECT 3 * c_custkey + 1, cost, 0 FROM c
UNION ALL SELECT 3 * o_orderkey + 2, least(by_customer, direct), CASE WHEN by_customer < direct THEN 3 * o_custkey + 1 ELSE 0 END FROM o""")
def _(t):
    k = F.floor(F.col("b") / 3)
    w = F.when(F.col("b") % 3 == 1, k % 7 + 1.0).when(F.col("a") % 3 == 1, k % 5 - 0.5).otherwise(6.0 + k % 3)
    return graphs.shortest_paths(_places(t).withColumn("w", w), t("nation").where("n_nationkey = 0").select((3 * F.col("n_nationkey")).cast("long").alias("node")))


@query("graph_distances", """
WITH RECURSIVE e AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
r AS (SELECT 's1' AS node, 0 AS dist UNION SELECT e.b, r.dist + 1 FROM r JOIN e ON r.node = e.a WHERE r.dist < 8)
SELECT node, min(dist) AS dist FROM r GROUP BY 1""")
def _(t):
    return graphs.distances(_tradings(t), t("supplier").where("s_suppkey = 1").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))


@query("graph_triangles", f"WITH e AS {_BOTH} SELECT count(*) AS n FROM e x JOIN e y ON x.b = y.a AND x.a < x.b AND y.a < y.b JOIN e z ON z.a = x.a AND z.b = y.b")
def _(t):
    return graphs.triangles(_places(t))


@query("graph_page_rank", f"""
WITH RECURSIVE e AS {_BOTH}, o AS (SELECT a AS node, count(*) AS out FROM e GROUP BY 1), n AS (SELECT count(*) AS n FROM o),
r AS (SELECT 0 AS i, node, 1.0::DOUBLE / n AS rank FROM o, n UNION ALL SELECT i + 1, e.b, any_value(0.15::DOUBLE / n) + 0.85::DOUBLE * sum(rank / out) FROM r JOIN o USING (node) JOIN e ON e.a = r.node, n WHERE i < 20 GROUP BY i, e.b)
SELECT node, round(rank, 9) AS rank FROM r WHERE i = 20""")
def _(t):
    return graphs.page_rank(graphs.both_ways(_places(t))).select("node", F.round("rank", 9).alias("rank"))


@query("standardize", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def _(t):
    return learning.standardize(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("robust_scale", "WITH e AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer) SELECT c_custkey, round((c_acctbal - q[2]) / (q[3] - q[1]), 6) AS c_acctbal FROM customer, e")
def _(t):
    return learning.robust_scale(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("impute_mean", "SELECT event_id, round(coalesce(CASE WHEN event_id % 7 <> 0 THEN value END, (SELECT avg(value) FROM events WHERE event_id % 7 <> 0)), 6) AS v FROM events")
def _(t):
    df = t("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return learning.impute(df, ["v"]).select("event_id", F.round("v", 6).alias("v"))


@query("target_means", "SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 4) AS m FROM customer")
def _(t):
    return learning.target_means(t("customer"), "c_mktsegment", "c_acctbal").select("c_custkey", F.round("c_mktsegment_target", 4).alias("m"))


@query("linear_fit", """
WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)
SELECT round(sqrt(avg(pow(l_extendedprice - s * l_quantity - i, 2))), 2) AS rmse, round(1 - avg(pow(l_extendedprice - s * l_quantity - i, 2)) / var_pop(l_extendedprice), 5) AS r2 FROM lineitem, m""")
def _(t):
    df = t("lineitem").select("l_extendedprice", "l_quantity")
    found = learning.predict(df, learning.fit(df, "linear", ["l_quantity"], "l_extendedprice"))
    return found.agg(*learning.regression_measures("l_extendedprice", "prediction")).select(F.round("rmse", 2).alias("rmse"), F.round("r2", 5).alias("r2"))


@query("rule_measures", """
WITH p AS (SELECT value > 50 AS p, event_type = 'purchase' AS y FROM events)
SELECT round(avg(CASE WHEN p = y THEN 1.0 ELSE 0 END), 6) AS accuracy, round(count(*) FILTER (p AND y) / count(*) FILTER (p), 6) AS precision, round(count(*) FILTER (p AND y) / count(*) FILTER (y), 6) AS recall, round(2 * count(*) FILTER (p AND y) / (count(*) FILTER (p) + count(*) FILTER (y)), 6) AS f1 FROM p""")
def _(t):
    made = t("events").agg(*learning.class_measures(F.col("event_type") == "purchase", F.col("value") > 50))
    return made.select(*(F.round(c, 6).alias(c) for c in made.columns))


def _labelled(t):
    return t("lineitem").select("l_quantity", "l_extendedprice", "l_discount", (F.col("l_quantity") > 25).cast("int").alias("y"))


for kind in ("logistic", "tree", "forest"):
    @query(f"fit_{kind}")
    def _(t, kind=kind):
        df = _labelled(t)
        found = learning.predict(df, learning.fit(df, kind, ["l_extendedprice", "l_discount"], "y"))
        return learning.confusion(found, "y", "prediction")


@query("fit_kmeans")
def _(t):
    df = _labelled(t)
    return learning.predict(df, learning.fit(df, "kmeans", ["l_quantity", "l_discount"], k=3)).groupBy("prediction").agg(F.count("*").alias("n"))


@query("penalized_slopes", """
WITH m AS (SELECT covar_pop(l_quantity, l_quantity * (1 - l_discount)) AS c, var_pop(l_quantity) AS v, stddev_samp(l_quantity * (1 - l_discount)) AS s, avg(l_quantity) AS x, avg(l_quantity * (1 - l_discount)) AS y FROM lineitem),
w AS (SELECT 'lasso' AS kind, sign(c) * greatest(abs(c) - 20, 0) / v AS w, x, y FROM m UNION ALL SELECT 'elastic_net', sign(c) * greatest(abs(c) - 10, 0) / (v + 10 / s), x, y FROM m UNION ALL SELECT 'lasso_all_out', sign(c) * greatest(abs(c) - 1000, 0) / v, x, y FROM m)
SELECT kind, round(w, 4) + 0.0 AS slope, round(y - w * x, 3) AS intercept FROM w""")
def _(t):
    """One feature's slope under a penalty has a closed form: the covariance, moved towards 0 by the penalty on its size."""
    df, out = t("lineitem").select("l_quantity", (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("y")), []
    for name, kind, penalty in (("lasso", "lasso", 20.0), ("elastic_net", "elastic_net", 20.0), ("lasso_all_out", "lasso", 1000.0)):
        model = learning.fit(df, kind, ["l_quantity"], "y", regParam=penalty, tol=1e-10).stages[-1]
        out.append((name, round(float(model.coefficients[0]), 4), round(model.intercept, 3)))
    return df.sparkSession.createDataFrame(out, "kind string, slope double, intercept double")
