"""Queries over single numbers, vectors, further tests, models, graphs and text forms of frames."""

from pyspark.sql import functions as F

from gridloom.functions import numbers as N
from gridloom.functions import statistics as S
from gridloom.functions import vectors as V
from gridloom.operators import ensembles, frame, graphs, learning
from gridloom.operators import windows as W
from gridloom.plans.models import PHI
from gridloom.registry import query
from gridloom.sources import files
from gridloom.streaming import windows as T

#: Columns made of p (p_size), q (p_retailprice) and k (p_partkey), and the same in SQL.
NUMBERS = {
    "clamp": (lambda p, q, k: N.clamp(p, 10, 30), "least(greatest(p, 10), 30)"),
    "lerp": (lambda p, q, k: N.lerp(p, q, F.lit(0.25)), "p + (q - p) * 0.25"),
    "inverse_lerp": (lambda p, q, k: N.inverse_lerp(F.lit(900.0), F.lit(2100.0), q), "(q - 900) / 1200"),
    "smoothstep": (lambda p, q, k: N.smoothstep(10, 40, p), "pow(least(greatest((p - 10) / 30, 0), 1), 2) * (3 - 2 * least(greatest((p - 10) / 30, 0), 1))"),
    "smootherstep": (lambda p, q, k: N.smootherstep(10, 40, p), "pow(least(greatest((p - 10) / 30, 0), 1), 3) * (6 * pow(least(greatest((p - 10) / 30, 0), 1), 2) - 15 * least(greatest((p - 10) / 30, 0), 1) + 10)"),
    "step": (lambda p, q, k: N.step(25, p), "CASE WHEN p < 25 THEN 0 ELSE 1 END"),
    "fract": (lambda p, q, k: N.fract(25 - q), "(25 - q) - floor(25 - q)"),
    "trunc": (lambda p, q, k: N.trunc(1500 - q), "trunc(1500 - q)"),
    "wrap": (lambda p, q, k: N.wrap(q, 100, 460), "100 + ((q - 100) - 360 * floor((q - 100) / 360))"),
    "snap": (lambda p, q, k: N.snap(p, 7.0), "round(p / 7.0) * 7"),
    "map_range": (lambda p, q, k: N.map_range(p, 1, 50, -1, 1), "-1 + (p - 1) * 2.0 / 49"),
    "gcd": (lambda p, q, k: N.gcd(p * 6, k), "gcd((p * 6)::BIGINT, k)"),
    "lcm": (lambda p, q, k: N.lcm(p, k), "lcm(p::BIGINT, k)"),
    "binomial": (lambda p, q, k: N.binomial(p % 20, k % 7), "CASE WHEN k % 7 > p % 20 THEN 0 ELSE round(factorial((p % 20)::INTEGER) / factorial((k % 7)::INTEGER) / factorial(((p % 20) - (k % 7))::INTEGER)) END"),
    "isqrt": (lambda p, q, k: N.isqrt(k * 1000), "floor(sqrt(k * 1000))"),
    "is_prime": (lambda p, q, k: N.is_prime(k).cast("int"), "CASE WHEN k >= 2 AND NOT list_bool_or(list_transform(range(2, k), lambda d: k % d = 0 AND d * d <= k)) THEN 1 WHEN k = 2 THEN 1 ELSE 0 END"),
    "factorial": (lambda p, q, k: F.factorial((p % 15).cast("int")), "factorial((p % 15)::INTEGER)"),
    "popcount": (lambda p, q, k: F.bit_count(k), "bit_count(k)"),
    "hypot": (lambda p, q, k: F.hypot(p, q), "sqrt(p * p + q * q)"),
    "cbrt": (lambda p, q, k: F.cbrt(q), "cbrt(q)"),
    "sign": (lambda p, q, k: F.signum(q - 1500), "sign(q - 1500)"),
    "degrees": (lambda p, q, k: F.degrees(p / 10), "degrees(p / 10)"),
    "atan2": (lambda p, q, k: F.atan2(p, q), "atan2(p, q)"),
    "log1p": (lambda p, q, k: F.log1p(p), "ln(1 + p)"),
    "tanh": (lambda p, q, k: F.tanh(p / 50), "tanh(p / 50)"),
    "about": (lambda p, q, k: N.about(p, F.floor(p / 2) * 2, 0.5).cast("int"), "CASE WHEN abs(p - floor(p / 2) * 2) <= 0.5 THEN 1 ELSE 0 END"),
}


@query("core_numbers", "SELECT p_partkey, " + ", ".join(f"round(CAST({sql} AS DOUBLE), 6) AS {n}" for n, (_, sql) in NUMBERS.items()) + " FROM (SELECT p_partkey, p_size::DOUBLE AS p, p_retailprice AS q, p_partkey AS k FROM part)")
def _(t):
    p, q, k = F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("p_partkey")
    return t("part").select("p_partkey", *(F.round(f(p, q, k).cast("double"), 6).alias(n) for n, (f, _) in NUMBERS.items()))


_V = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_transform(list_reverse(embedding), lambda x: x::DOUBLE) AS b FROM embeddings)"
_ZIP = "list_transform(range(1, len(a) + 1), lambda i: {f})"
VECTORS = {
    "dot": (lambda a, b: V.dot(a, b), "list_sum(" + _ZIP.format(f="a[i] * b[i]") + ")"),
    "cosine": (lambda a, b: V.cosine_similarity(a, b), "list_cosine_similarity(a, b)"),
    "euclidean": (lambda a, b: V.euclidean(a, b), "list_distance(a, b)"),
    "manhattan": (lambda a, b: V.manhattan(a, b), "list_sum(" + _ZIP.format(f="abs(a[i] - b[i])") + ")"),
    "chebyshev": (lambda a, b: V.chebyshev(a, b), "list_max(" + _ZIP.format(f="abs(a[i] - b[i])") + ")"),
    "added": (lambda a, b: V.norm(V.add(a, b)), "sqrt(list_sum(" + _ZIP.format(f="pow(a[i] + b[i], 2)") + "))"),
    "scaled": (lambda a, b: V.norm(V.scale(a, 3.0)), "3 * sqrt(list_sum(" + _ZIP.format(f="a[i] * a[i]") + "))"),
    "hadamard": (lambda a, b: V.hadamard(a, b)[5], "a[6] * b[6]"),
    "argmax": (lambda a, b: V.argmax(a), "list_position(a, list_max(a)) - 1"),
    "argmin": (lambda a, b: V.argmin(a), "list_position(a, list_min(a)) - 1"),
    "normalized": (lambda a, b: V.normalized(a)[3], "a[4] / sqrt(list_sum(" + _ZIP.format(f="a[i] * a[i]") + "))"),
    "project": (lambda a, b: V.project(a, b)[2], "b[3] * list_sum(" + _ZIP.format(f="a[i] * b[i]") + ") / list_sum(" + _ZIP.format(f="b[i] * b[i]") + ")"),
    "outer": (lambda a, b: V.outer(a, b)[1][2], "a[2] * b[3]"),
    "clipped": (lambda a, b: V.norm(V.clip(a, -0.1, 0.1)), "sqrt(list_sum(" + _ZIP.format(f="pow(least(greatest(a[i], -0.1), 0.1), 2)") + "))"),
    "linspace": (lambda a, b: V.linspace(a[0].cast("double"), b[0].cast("double"), 5)[3], "a[1] + (b[1] - a[1]) * 0.75"),
}


@query("vector_functions", "SELECT vec_id, " + ", ".join(f"round(CAST({sql} AS DOUBLE), 6) AS {n}" for n, (_, sql) in VECTORS.items()) + f" FROM {_V}")
def _(t):
    df = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a")).withColumn("b", F.reverse("a"))
    return df.select("vec_id", *(F.round(f(F.col("a"), F.col("b")).cast("double"), 6).alias(n) for n, (f, _) in VECTORS.items()))


@query("wilcoxon", """
WITH d AS (SELECT l_discount * 100 - l_tax * 100 AS d FROM lineitem), s AS (SELECT round(d) AS d, abs(round(d)) AS a FROM d WHERE round(d) <> 0),
r AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM s), w AS (SELECT CAST(sum(r) FILTER (d > 0) AS DOUBLE) AS w, CAST(count(*) AS DOUBLE) AS n FROM r)
SELECT round(w, 1) AS w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM w""")
def _(t):
    df = t("lineitem").select(F.round(F.col("l_discount") * 100 - F.col("l_tax") * 100).alias("a"), F.lit(0.0).alias("b"))
    return S.wilcoxon(df, "a", "b").select(F.round("w", 1).alias("w"), F.round("z", 6).alias("z"))


@query("power", f"""
WITH n AS (SELECT p_partkey, (p_size % 10 + 1) / 20.0::DOUBLE AS d, (p_size + 5)::DOUBLE AS n FROM part), s AS (SELECT *, d * sqrt(n / 2) AS a, d * sqrt(n) AS b FROM n)
SELECT p_partkey, round({PHI.format(x="a - 1.959963984540054")} + {PHI.format(x="-a - 1.959963984540054")}, 8) AS two, round({PHI.format(x="b - 1.959963984540054")} + {PHI.format(x="-b - 1.959963984540054")}, 8) AS one,
CAST(ceil(2 * pow((1.959963984540054 + 0.8416212335729143) / d, 2)) AS BIGINT) AS size FROM s""")
def _(t):
    d, n = (F.col("p_size") % 10 + 1) / 20.0, (F.col("p_size") + 5).cast("double")
    return t("part").select("p_partkey", F.round(S.power_two_sample(d, n), 8).alias("two"), F.round(S.power_one_sample(d, n), 8).alias("one"), S.size_two_sample(d).cast("long").alias("size"))


@query("corrections", """
WITH p AS (SELECT s_suppkey, (s_suppkey * 37 % 1000) / 50000.0::DOUBLE AS p FROM supplier), r AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, s_suppkey) + 1) AS q, least(1.0, p * count(*) OVER ()) AS b FROM p)
SELECT s_suppkey, round(least(1.0, max(q) OVER (ORDER BY p, s_suppkey)), 9) AS holm, round(b, 9) AS bonferroni FROM r""")
def _(t):
    df = t("supplier").select("s_suppkey", ((F.col("s_suppkey") * 37 % 1000) / 50000.0).alias("p"))
    holm = S.holm(df, "s_suppkey", "p").select("s_suppkey", F.round("adjusted", 9).alias("holm"))
    return holm.join(S.bonferroni(df, "p").select("s_suppkey", F.round("adjusted", 9).alias("bonferroni")), "s_suppkey")


@query("fill_ways", """
WITH g AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 10 <> 3 THEN value END AS v FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS forward, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM g""")
def _(t):
    df = t("events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 10 != 3, F.col("value")).alias("v"))
    made = W.interpolate(df, "v", "forward", ["user_id"], ["ts", "event_id"], "forward")
    return W.interpolate(made, "v", "backward", ["user_id"], ["ts", "event_id"], "backward").select("event_id", "forward", "backward")


@query("quantile_transform", """
SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 - 1) / (count(*) OVER () - 1), 9) AS u FROM customer""")
def _(t):
    return learning.quantile_transform(t("customer"), "c_acctbal", "u").select("c_custkey", F.round("u", 9).alias("u"))


@query("best_features", """
WITH l AS (SELECT l_returnflag AS y, unnest([{'c': 'l_quantity', 'x': l_quantity::DOUBLE}, {'c': 'l_extendedprice', 'x': l_extendedprice::DOUBLE}, {'c': 'l_tax', 'x': l_tax::DOUBLE}]) AS s FROM lineitem),
g AS (SELECT s.c AS c, y, count(*) AS n, avg(s.x) AS m, var_pop(s.x) * count(*) AS w FROM l GROUP BY 1, 2)
SELECT c AS "column", round((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))), 5) AS f FROM g GROUP BY 1""")
def _(t):
    return learning.best_features(t("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], "l_returnflag").withColumn("f", F.round("f", 5))


@query("naive_bayes_gaussian", """
WITH d AS (SELECT (l_quantity > 25)::INTEGER AS y, l_extendedprice::DOUBLE AS a, l_discount::DOUBLE AS b FROM lineitem), e AS (SELECT 1e-9 * greatest(var_pop(a), var_pop(b)) AS e FROM d),
s AS (SELECT y, ln(count(*)::DOUBLE / (SELECT count(*) FROM d)) AS p, avg(a) AS ma, var_pop(a) + any_value(e) AS va, avg(b) AS mb, var_pop(b) + any_value(e) AS vb FROM d, e GROUP BY 1),
w AS (SELECT y, (SELECT arg_max(s.y, s.p - ln(va * vb) / 2 - pow(a - ma, 2) / (2 * va) - pow(b - mb, 2) / (2 * vb)) FROM s) AS said FROM d)
SELECT y AS actual, said::DOUBLE AS predicted, count(*) AS n FROM w GROUP BY 1, 2""")
def _(t):
    df = t("lineitem").select("l_extendedprice", "l_discount", (F.col("l_quantity") > 25).cast("int").alias("y"))
    return learning.confusion(learning.predict(df, learning.fit(df, "naive_bayes", ["l_extendedprice", "l_discount"], "y")), "y", "prediction")


@query("ridge_fit", """
WITH s AS (SELECT count(*) AS n, covar_pop(l_extendedprice, l_quantity) AS c, var_pop(l_quantity) AS v, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem), b AS (SELECT c / (v + 10.0) AS b, my - c / (v + 10.0) * mx AS i FROM s)
SELECT l_orderkey * 10 + l_linenumber AS id, round(i + b * l_quantity, 2) AS p FROM lineitem, b""")
def _(t):
    df = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice")
    return learning.predict(df, learning.fit_ridge(df, ["l_quantity"], "l_extendedprice", 10.0)).select("id", F.round("prediction", 2).alias("p"))


@query("principal_components", """
WITH m AS (SELECT avg(c_nationkey) AS mx, avg(c_acctbal) AS my, var_samp(c_nationkey) AS a, var_samp(c_acctbal) AS b, covar_samp(c_nationkey, c_acctbal) AS c FROM customer), t AS (SELECT *, atan2(2 * c, a - b) / 2 AS t FROM m),
d AS (SELECT *, cos(t) AS u, sin(t) AS v FROM t), s AS (SELECT *, CASE WHEN abs(u) >= abs(v) THEN sign(u) ELSE sign(v) END AS k, CASE WHEN abs(v) >= abs(u) THEN sign(-v) ELSE sign(u) END AS l FROM d)
SELECT c_custkey, round(k * (u * (c_nationkey - mx) + v * (c_acctbal - my)), 4) AS pc_0, round(l * (-v * (c_nationkey - mx) + u * (c_acctbal - my)), 4) AS pc_1 FROM customer, s""")
def _(t):
    out = learning.principal_components(t("customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey", "c_acctbal"], 2)
    return out.select("c_custkey", F.round("pc_0", 4).alias("pc_0"), F.round("pc_1", 4).alias("pc_1"))


@query("grid_search")
def _(t):
    df = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice")
    score = 1 - F.try_divide(F.avg(F.pow(F.col("l_extendedprice") - F.col("prediction"), F.lit(2))), F.var_pop("l_extendedprice"))
    return learning.grid_search(df, "ridge", ["l_quantity"], "l_extendedprice", "id", 2, score, {"regParam": [0.0, 1000.0]})


@query("isolation_forest")
def _(t):
    df = t("customer").select("c_custkey", "c_acctbal", "c_nationkey")
    model = ensembles.isolation_forest(df, ["c_acctbal", "c_nationkey"], "c_custkey", trees=50)
    return df.select("c_custkey", F.round(ensembles.anomaly(model, "c_acctbal", "c_nationkey"), 6).alias("score"))


@query("voting")
def _(t):
    df = t("lineitem").select("l_extendedprice", "l_discount", (F.col("l_quantity") > 25).cast("int").alias("y"))
    return learning.confusion(ensembles.voting(df, ["logistic", "naive_bayes", "tree"], ["l_extendedprice", "l_discount"], "y").predict(df), "y", "prediction")


@query("ada_boost")
def _(t):
    df = t("lineitem").select("l_extendedprice", "l_discount", (F.col("l_quantity") > 25).cast("int").alias("y"))
    return learning.confusion(ensembles.ada_boost(df, ["l_extendedprice", "l_discount"], "y", rounds=3).predict(df), "y", "prediction")


def _ring(t):
    """Each order points to its customer and back where the key is even, and to the next order of the customer's nation."""
    o = t("orders").select("o_orderkey", "o_custkey")
    order, customer = F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey")
    return o.select(order.alias("a"), customer.alias("b")).union(o.where("o_orderkey % 2 = 0").select(customer, order))


@query("strong_components", """
WITH o AS (SELECT 'o' || o_orderkey AS o, 'c' || o_custkey AS c, o_orderkey % 2 = 0 AS back FROM orders)
SELECT o AS node, CASE WHEN back THEN c ELSE o END AS component FROM o UNION SELECT c, c FROM o""")
def _(t):
    return graphs.strong_components(_ring(t))


@query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def _(t):
    return t("orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("csv_string", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    df = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    return files.read_csv_from_string(df.sparkSession, files.to_csv_string(df))


@query("json_string", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    df = t("nation").select("n_nationkey", "n_name")
    return files.from_json_string(df.sparkSession, files.to_json_string(df), ["n_nationkey", "n_name"])


@query("frame_columns", "SELECT o_orderkey AS key, o_totalprice * 2 AS twice FROM orders")
def _(t):
    df = frame.add_column(t("orders").select("o_orderkey", "o_totalprice"), "twice", F.col("o_totalprice") * 2)
    return frame.rename_column(frame.drop_column(df, "o_totalprice"), "o_orderkey", "key")


@query("sliding_windows", """
WITH s AS (SELECT event_type, ts, event_id, unnest([0, 1]) AS back FROM events)
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - back * INTERVAL 6 HOUR AS start, event_type, count(*) AS n FROM s GROUP BY 1, 2""")
def _(t):
    return T.tumbling(t("events"), "12 hours", slide="6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("enriched_events", "SELECT event_id, c_name FROM events LEFT JOIN customer ON user_id = c_custkey")
def _(t):
    return T.enriched(t("events"), t("customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id").select("event_id", "c_name")
