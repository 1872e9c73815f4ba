"""Queries over the rest of the functions: money, signals, special functions, text, statistics, hooks of the user's own."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import distributions as D
from gridloom.functions import finance, hooks, signals, text
from gridloom.functions import statistics as S
from gridloom.operators import learning, rows
from gridloom.operators import windows as W
from gridloom.operators.windows import ordered
from gridloom.plans.models import _D1, _D2, PHI
from gridloom.registry import query
from gridloom.streaming import windows as T

_DENSITY = f"exp(-pow({_D1}, 2) / 2) / sqrt(2 * pi())"


@query("option_greeks", f"""
SELECT p_partkey, round(1000 * exp(-0.03) * {PHI.format(x="-" + _D2)} - p_retailprice * {PHI.format(x="-" + _D1)}, 4) AS put, round({PHI.format(x=_D1)}, 6) AS delta, round({_DENSITY} / (p_retailprice * 0.2), 8) AS gamma,
round(p_retailprice * {_DENSITY}, 4) AS vega, round(-p_retailprice * {_DENSITY} * 0.1 - 30 * exp(-0.03) * {PHI.format(x=_D2)}, 4) AS theta, round(1000 * exp(-0.03) * {PHI.format(x=_D2)}, 4) AS rho FROM part""")
def _(t):
    terms = (F.col("p_retailprice"), F.lit(1000.0), F.lit(0.03), F.lit(0.2), F.lit(1.0))
    digits = {"delta": 6, "gamma": 8}
    made = {"put": finance.black_scholes_put(*terms), **finance.greeks(*terms)}
    return t("part").select("p_partkey", *(F.round(c, digits.get(n, 4)).alias(n) for n, c in made.items()))


MONEY = {
    "future_value": (lambda p, n: finance.future_value(p, F.lit(0.05), n), "p * pow(1.05, n)"),
    "present_value": (lambda p, n: finance.present_value(p, F.lit(0.05), n), "p / pow(1.05, n)"),
    "payment": (lambda p, n: finance.payment(p, F.lit(0.05), n), "p * 0.05 / (1 - pow(1.05, -n))"),
    "annuity_future": (lambda p, n: finance.annuity_future(p, F.lit(0.05), n), "p * (pow(1.05, n) - 1) / 0.05"),
    "annuity_present": (lambda p, n: finance.annuity_present(p, F.lit(0.05), n), "p * (1 - pow(1.05, -n)) / 0.05"),
    "straight_line": (lambda p, n: finance.straight_line(p, p / 10, n), "p * 0.9 / n"),
    "declining_balance": (lambda p, n: finance.declining_balance(p, F.lit(2.0), n + 2, F.lit(3)), "p * 2.0 / (n + 2) * pow(1 - 2.0 / (n + 2), 2)"),
    "compound": (lambda p, n: finance.compound(p, F.lit(0.05), F.lit(12), n), "p * pow(1 + 0.05 / 12, 12 * n)"),
    "effective_rate": (lambda p, n: finance.effective_rate(F.lit(0.05), n), "pow(1 + 0.05 / n, n) - 1"),
    "growth_rate": (lambda p, n: finance.growth_rate(F.lit(500.0), p, n), "pow(p / 500, 1 / n) - 1"),
}


@query("money_over_time", "SELECT p_partkey, " + ", ".join(f"round({sql} + 0.00000013, 6) AS {n}" for n, (_, sql) in MONEY.items()) + " FROM (SELECT p_partkey, p_retailprice AS p, p_size::DOUBLE AS n FROM part)")
def _(t):
    p, n = F.col("p_retailprice"), F.col("p_size").cast("double")
    return t("part").select("p_partkey", *(F.round(f(p, n) + 0.00000013, 6).alias(k) for k, (f, _) in MONEY.items()))


@query("risk_measures", """
WITH r AS (SELECT l_returnflag, l_discount - l_tax AS r FROM lineitem)
SELECT l_returnflag, round(avg(r) / stddev_samp(r), 6) AS sharpe, round(avg(r) / sqrt(avg(pow(least(r, 0), 2))), 6) AS sortino, round(-(avg(r) - 1.6448536269514722 * stddev_pop(r)), 6) AS normal_var FROM r GROUP BY 1""")
def _(t):
    df = t("lineitem").withColumn("r", F.col("l_discount") - F.col("l_tax"))
    return df.groupBy("l_returnflag").agg(F.round(finance.sharpe("r"), 6).alias("sharpe"), F.round(finance.sortino("r"), 6).alias("sortino"), F.round(finance.normal_value_at_risk("r"), 6).alias("normal_var"))


@query("value_at_risk", "SELECT round(-quantile_cont(c_acctbal, 0.05), 6) AS value_at_risk FROM customer")
def _(t):
    return finance.value_at_risk(t("customer"), "c_acctbal").select(F.round("value_at_risk", 6).alias("value_at_risk"))


@query("durations", "SELECT o_orderpriority, round(sum(f * t / pow(1.03, t)) / sum(f / pow(1.03, t)), 6) AS duration FROM (SELECT o_orderpriority, o_totalprice AS f, o_custkey % 12 AS t FROM orders) GROUP BY 1")
def _(t):
    df = t("orders").withColumn("t", F.col("o_custkey") % 12)
    return df.groupBy("o_orderpriority").agg(F.round(finance.duration("o_totalprice", "t", 0.03), 6).alias("duration"))


_W = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {a} AND {b})"


@query("signal_measures", f"""
SELECT event_id, round(max(abs(value)) OVER {_W.format(a="3 PRECEDING", b="3 FOLLOWING")}, 6) AS envelope, round(sqrt(avg(value * value) OVER {_W.format(a="4 PRECEDING", b="CURRENT ROW")}), 6) AS energy FROM events""")
def _(t):
    w = ordered(["user_id"], ["ts", "event_id"])
    return t("events").select("event_id", F.round(signals.envelope("value", 7, w), 6).alias("envelope"), F.round(signals.energy("value", 5, w), 6).alias("energy"))


@query("onsets", f"""
WITH e AS (SELECT event_id, user_id, ts, sqrt(avg(value * value) OVER {_W.format(a="2 PRECEDING", b="CURRENT ROW")}) AS e FROM events), d AS (SELECT event_id, e, lag(e) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM e)
SELECT event_id FROM d WHERE e > 1.5 * b""")
def _(t):
    return signals.onsets(t("events"), "value", ["user_id"], ["ts", "event_id"], 3, 1.5).select("event_id")


@query("special_functions", """
SELECT p_partkey, round(list_sum(list_transform(range(1, p_size + 1), lambda i: 1.0 / i)) - 1.0 / p_size - 0.5772156649015329, 8) AS digamma,
round(list_sum(list_transform(range(400), lambda j: cos(((p_size % 4) * 2 * pi() * j / 400) - p_size / 5.0 * sin(2 * pi() * j / 400)))) / 400, 8) AS bessel FROM part""")
def _(t):
    made = {"digamma": D.function("digamma", F.col("p_size").cast("double")), "bessel": D.function("bessel_j", (F.col("p_size") % 4).cast("double"), F.col("p_size") / 5.0)}
    return t("part").select("p_partkey", *(F.round(c, 8).alias(n) for n, c in made.items()))


@query("zeta_of_even", "SELECT n_nationkey, round(CASE n_nationkey % 3 WHEN 0 THEN pow(pi(), 2) / 6 WHEN 1 THEN pow(pi(), 4) / 90 ELSE pow(pi(), 6) / 945 END, 10) AS zeta FROM nation")
def _(t):
    return t("nation").select("n_nationkey", F.round(D.function("zeta", (2 + 2 * (F.col("n_nationkey") % 3)).cast("double")), 10).alias("zeta"))


@query("text_trims", "SELECT p_partkey, trim('  ' || p_name || ' ') AS stripped, regexp_replace(p_type, 'E', '_') AS first, repeat(p_brand, 2) AS twice, nullif(split_part(p_type, ' ', 3), '') AS third FROM part")
def _(t):
    c = F.col
    return t("part").select(
        "p_partkey", text.strip(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("stripped"), text.replace(c("p_type"), "E", "_", 1).alias("first"),
        F.repeat("p_brand", 2).alias("twice"), text.piece(c("p_type"), " ", 2).alias("third"),
    )


@query("date_pieces", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dow FROM orders")
def _(t):
    return t("orders").select("o_orderkey", *text.date_parts("o_orderdate", ["year", "month", "dow"]))


@query("running_moments", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def _(t):
    return T.running_moments(t("events")).select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), "low", "high")


@query("repeated_events", "SELECT count(DISTINCT event_id) AS n FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events)")
def _(t):
    return T.without_repeats(t("events").union(t("events"))).agg(F.count("*").alias("n"))


@query("jackknife", "SELECT round(avg(c_acctbal), 6) AS estimate, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS error FROM customer")
def _(t):
    return t("customer").agg(*S.jackknife("c_acctbal")).select(F.round("estimate", 6).alias("estimate"), F.round("error", 6).alias("error"))


@query("t_test_p", f"""
WITH s AS (SELECT (avg(l_discount - l_tax)) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))) / 40 AS t FROM lineitem)
SELECT round(t, 6) AS t, round(2 * (1 - {PHI.format(x="abs(t)")}), 3) AS p FROM s""")
def _(t):
    df = t("lineitem").agg((S.paired_t("l_discount", "l_tax") / 40).alias("t"), F.count("*").alias("n"))
    return df.select(F.round("t", 6).alias("t"), F.round(D.two_sided(F.col("t"), (F.col("n") - 1).cast("double")), 3).alias("p"))


@query("impute_median", "SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN value END, (SELECT quantile_cont(value, 0.5) FROM events WHERE event_id % 7 <> 0)) AS v FROM events")
def _(t):
    return learning.impute(t("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v")), ["v"], "median")


@query("row_norms", "SELECT l_orderkey * 10 + l_linenumber AS id, round(abs(l_tax) + abs(l_discount), 6) AS l1, round(sqrt(l_tax * l_tax + l_discount * l_discount), 6) AS l2 FROM lineitem")
def _(t):
    return t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *(F.round(learning.row_norm(["l_tax", "l_discount"], k), 6).alias(k) for k in ("l1", "l2")))


@query("multi_key_join", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1")
def _(t):
    from gridloom.operators.joins import merge

    df = t("lineitem")
    before = df.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), "l_quantity")
    return merge(df.select("l_orderkey", "l_linenumber"), before, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("monte_carlo_pi", """
WITH u AS (SELECT ('0x' || substr(md5('1:' || l_orderkey * 10 + l_linenumber), 1, 15))::BIGINT / pow(2, 60) AS x, ('0x' || substr(md5('2:' || l_orderkey * 10 + l_linenumber), 1, 15))::BIGINT / pow(2, 60) AS y FROM lineitem)
SELECT round(4 * avg(CASE WHEN x * x + y * y < 1 THEN 1.0 ELSE 0 END), 6) AS pi FROM u""")
def _(t):
    df = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    x, y = (rows.by_chance("k", s) / float(1 << 60) for s in (1, 2))
    return df.agg(F.round(4 * F.avg((x * x + y * y < 1).cast("double")), 6).alias("pi"))


@query("user_function", "SELECT p_partkey, round(log10(p_retailprice) * p_size, 6) AS v FROM part")
def _(t):
    df = t("part")
    f = hooks.register_function(df.sparkSession, "log_times", lambda a, b: np.log10(a) * b, "double")
    return df.select("p_partkey", F.round(f("p_retailprice", "p_size"), 6).alias("v"))


@query("user_aggregate", "SELECT n_regionkey, max(n_nationkey) - min(n_nationkey) AS wide FROM nation GROUP BY 1")
def _(t):
    df = t("nation")
    f = hooks.register_aggregate(df.sparkSession, "wide", lambda a: int(a.max() - a.min()), "long")
    return df.groupBy("n_regionkey").agg(f("n_nationkey").alias("wide"))


@query("user_table", "SELECT n_nationkey, i AS k, i * i AS square FROM nation, range(3) r(i)")
def _(t):
    df = t("nation")
    hooks.register_table(df.sparkSession, "squares", lambda n: ((i, i * i) for i in range(n)), "k long, square long")
    df.createOrReplaceTempView("__nation")
    return df.sparkSession.sql("SELECT n_nationkey, k, square FROM __nation, LATERAL squares(3)")


@query("user_fold", "SELECT l_orderkey, list_reduce(list(l_linenumber ORDER BY l_linenumber), lambda s, x: s * 2 + x) AS folded FROM lineitem GROUP BY 1")
def _(t):
    return hooks.fold_groups(t("lineitem"), ["l_orderkey"], "0L", "s * 2 + x", "l_linenumber", ["l_linenumber"], "folded")


@query("ranked_values", "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS DOUBLE) AS place FROM part")
def _(t):
    return t("part").select("p_partkey", W.rank("p_size", ["p_brand"], "dense").alias("place"))
