"""Queries over ordered columns."""

from pyspark.sql import functions as F

from gridloom.operators import scans
from gridloom.operators import windows as W
from gridloom.registry import query

ORDER = ["ts", "event_id"]
_OVER = "(PARTITION BY user_id ORDER BY ts, event_id)"
_FRAME = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {a} PRECEDING AND CURRENT ROW)"
#: Every tenth value is taken as unknown, so that nulls are met.
_GAPS = "(SELECT *, CASE WHEN event_id % 10 <> 3 THEN value END AS v FROM events)"
#: Added before rounding, as means of decimals often lie just between two.
_OFF_TIES = 0.00000013
_ALL = _FRAME.format(a="UNBOUNDED")


def _gaps(t):
    return t("events").withColumn("v", F.when(F.col("event_id") % 10 != 3, F.col("value")))


def _w():
    return W.ordered(["user_id"], ORDER)


SIMPLE = {
    "cumsum": (lambda w: W.cumsum("v", w), f"CASE WHEN v IS NOT NULL THEN sum(v) OVER {_ALL} END"),
    "diff": (lambda w: W.diff("v", w), f"v - lag(v) OVER {_OVER}"),
    "pct_change": (lambda w: W.pct_change("v", w), f"(v - lag(v) OVER {_OVER}) / nullif(lag(v) OVER {_OVER}, 0)"),
    "shift_back": (lambda w: W.shift("v", 2, w), f"lag(v, 2) OVER {_OVER}"),
    "shift_ahead": (lambda w: W.shift("v", -1, w), f"lead(v, 1) OVER {_OVER}"),
    "backward_fill": (lambda w: W.backward_fill("v", w), "first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    "cumprod": (lambda w: F.ln(W.cumprod("__u", w)), f"CASE WHEN v IS NOT NULL THEN sum(ln(1 + v / 1000)) OVER {_ALL} END"),
    "forward_fill": (lambda w: W.forward_fill("v", w), f"last_value(v IGNORE NULLS) OVER {_ALL}"),
    "moving_average": (lambda w: W.moving_average("v", 5, w), f"avg(v) OVER {_FRAME.format(a=4)}"),
    "median_filter": (lambda w: W.median_filter("v", 5, w), f"quantile_cont(v, 0.5) OVER {_FRAME.format(a=4)}"),
    "drawdown": (lambda w: W.drawdown("v", w), f"(max(v) OVER {_ALL} - v) / nullif(max(v) OVER {_ALL}, 0) * 100"),
    "clip": (lambda w: W.clip("v", 10.0, 60.0), "CASE WHEN v IS NOT NULL THEN least(greatest(v, 10), 60) END"),
    **{f"rolling_{op}": (lambda w, op=op: W.rolling(op, "v", 7, w), f"CASE WHEN count(v) OVER {_FRAME.format(a=6)} = 7 THEN {f}(v) OVER {_FRAME.format(a=6)} END") for op, f in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"))},
    **{f"expanding_{op}": (lambda w, op=op: W.expanding(op, "v", w), f"CASE WHEN v IS NOT NULL THEN {f}(v) OVER {_ALL} END") for op, f in (("mean", "avg"), ("sum", "sum"), ("var", "var_samp"))},
}
for name, (f, sql) in SIMPLE.items():
    @query(name, f"SELECT event_id, round(CAST({sql} AS DOUBLE) + {_OFF_TIES}, 6) AS out FROM {_GAPS}")
    def _(t, f=f):
        return _gaps(t).withColumn("__u", 1 + F.col("v") / 1000).select("event_id", F.round(f(_w()).cast("double") + _OFF_TIES, 6).alias("out"))


_P = "(PARTITION BY user_id)"
BESIDE = {
    "zscore": (lambda df: W.zscore(df, "v", "out", ["user_id"]), f"CASE WHEN stddev_samp(v) OVER {_P} = 0 THEN 0 ELSE (v - avg(v) OVER {_P}) / stddev_samp(v) OVER {_P} END"),
    "normalize": (lambda df: W.normalize(df, "v", "out", ["user_id"]), f"CASE WHEN min(v) OVER {_P} = max(v) OVER {_P} THEN 0 ELSE (v - min(v) OVER {_P}) / (max(v) OVER {_P} - min(v) OVER {_P}) END"),
    "normalize_maxabs": (lambda df: W.normalize(df, "v", "out", [], "maxabs"), "v / (SELECT max(abs(CASE WHEN event_id % 10 <> 3 THEN value END)) FROM events)"),
}
for name, (f, sql) in BESIDE.items():
    @query(name, f"SELECT event_id, round(CAST({sql} AS DOUBLE) + {_OFF_TIES}, 6) AS out FROM {_GAPS}")
    def _(t, f=f):
        return f(_gaps(t)).select("event_id", F.round(F.col("out").cast("double") + _OFF_TIES, 6).alias("out"))


_RANKS = {"dense": "dense_rank() OVER {o}", "min": "rank() OVER {o}", "max": "rank() OVER {o} + count(*) OVER {p} - 1", "average": "rank() OVER {o} + (count(*) OVER {p} - 1) / 2"}
for method, sql in _RANKS.items():
    @query(f"rank_{method}", "SELECT p_partkey, CAST(" + sql.format(o="(PARTITION BY p_brand ORDER BY p_size)", p="(PARTITION BY p_brand, p_size)") + " AS DOUBLE) AS out FROM part")
    def _(t, method=method):
        return t("part").select("p_partkey", W.rank("p_size", ["p_brand"], method).alias("out"))


@query("peaks", f"SELECT event_id FROM (SELECT event_id, value > lag(value) OVER {_OVER} AND value > lead(value) OVER {_OVER} AS p FROM events) WHERE p")
def _(t):
    return t("events").withColumn("p", W.is_peak("value", _w())).where("p").select("event_id")


@query("cut_price", "WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, CAST(least(floor((p_retailprice - lo) / ((hi - lo) / 8)), 7) AS INTEGER) AS bin FROM part, e")
def _(t):
    return W.cut(t("part"), "p_retailprice", 8, "bin").select("p_partkey", "bin")


@query("qcut_price", "SELECT p_partkey, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1) * 4 / count(*) OVER (PARTITION BY p_brand)) AS INTEGER) AS bin FROM part")
def _(t):
    return t("part").select("p_partkey", W.qcut("p_retailprice", 4, ["p_brand"], ["p_partkey"]).alias("bin"))


@query("interpolate_linear", f"""
WITH n AS (SELECT *, row_number() OVER {_OVER} AS i FROM {_GAPS}), k AS (
  SELECT *, CASE WHEN v IS NOT NULL THEN i END AS j FROM n
), f AS (
  SELECT event_id, v, i, last_value(v IGNORE NULLS) OVER a AS v0, first_value(v IGNORE NULLS) OVER b AS v1, last_value(j IGNORE NULLS) OVER a AS p0, first_value(j IGNORE NULLS) OVER b AS p1
  FROM k WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
) SELECT event_id, round(coalesce(v, v0 + (v1 - v0) * (i - p0) / nullif(p1 - p0, 0), v0, v1), 4) AS out FROM f""")
def _(t):
    return W.interpolate(_gaps(t), "v", "out", ["user_id"], ORDER).select("event_id", F.round("out", 4).alias("out"))


@query("outliers_iqr", "WITH e AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer) SELECT c_custkey FROM customer, e WHERE c_acctbal < a - 0.2 * (b - a) OR c_acctbal > b + 0.2 * (b - a)")
def _(t):
    return W.outlier_iqr(t("customer"), "c_acctbal", 0.2, "far").where("far").select("c_custkey")


@query("ewm_mean", f"""
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN list_reduce(list(v) FILTER (v IS NOT NULL) OVER {_ALL}, lambda a, x: a * (2.0 / 3)::DOUBLE + x * (1.0 / 3)::DOUBLE) END, 6) AS out FROM (SELECT event_id, user_id, ts, v::DOUBLE AS v FROM {_GAPS})""")
def _(t):
    return scans.ewm_mean(_gaps(t).select("event_id", "ts", "user_id", "v"), "v", 5, "out", ["user_id"], ORDER).select("event_id", F.round("out", 6).alias("out"))
