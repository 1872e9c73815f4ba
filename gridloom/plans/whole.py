"""Queries over ordered columns of a whole table, without a partition."""

from pyspark.sql import functions as F

from gridloom.operators import scans
from gridloom.operators import windows as W
from gridloom.registry import query

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
_ID = "l_orderkey, l_linenumber, l_partkey"
_BY = "ORDER BY " + ", ".join(ORDER)
#: Every tenth part's price is taken as unknown, so that nulls are met.
_GAPS = "(SELECT *, CASE WHEN l_partkey % 10 <> 3 THEN l_extendedprice END AS v, CASE WHEN l_partkey % 10 <> 3 THEN l_quantity END AS q FROM lineitem)"
#: Added before rounding, as means of decimals often lie just between two.
_OFF_TIES = 0.00000013
_ALL = f"({_BY} ROWS UNBOUNDED PRECEDING)"


def _gaps(t):
    known = F.col("l_partkey") % 10 != 3
    return t("lineitem").select(*ORDER, F.when(known, F.col("l_extendedprice")).alias("v"), F.when(known, F.col("l_quantity")).alias("q"))


def _out(df, *names):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *(F.round(F.col(n).cast("double") + _OFF_TIES, 6).alias(n) for n in names))


def _sql(**columns: str) -> str:
    return f"SELECT {_ID}, " + ", ".join(f"round(CAST({sql} AS DOUBLE) + {_OFF_TIES}, 6) AS {n}" for n, sql in columns.items()) + f" FROM {_GAPS}"


@query("whole_cumsum", _sql(total=f"CASE WHEN q IS NOT NULL THEN sum(q) OVER {_ALL} END"))
def _(t):
    return _out(scans.cumulative(_gaps(t), "sum", "q", "total", [], ORDER), "total")


@query("whole_cumprod", _sql(growth=f"CASE WHEN q IS NOT NULL THEN sum(ln(1 + q / 1000000)) OVER {_ALL} END"))
def _(t):
    df = _gaps(t).withColumn("q", 1 + F.col("q") / 1000000)
    return _out(scans.cumulative(df, "log_product", "q", "growth", [], ORDER), "growth")


@query("whole_cummax", _sql(highest=f"CASE WHEN v IS NOT NULL THEN max(v) OVER {_ALL} END"))
def _(t):
    return _out(scans.cumulative(_gaps(t), "max", "v", "highest", [], ORDER), "highest")


for _op, _f in (("mean", "avg"), ("var", "var_samp")):
    @query(f"whole_expanding_{_op}", _sql(out=f"CASE WHEN q IS NOT NULL THEN {_f}(q) OVER {_ALL} END"))
    def _(t, op=_op):
        return _out(scans.cumulative(_gaps(t), op, "q", "out", [], ORDER), "out")


@query("whole_drawdown", _sql(drop=f"(max(v) OVER {_ALL} - v) / nullif(max(v) OVER {_ALL}, 0) * 100"))
def _(t):
    return _out(scans.drawdown(_gaps(t), "v", "drop", [], ORDER), "drop")


_SEVEN = f"({_BY} ROWS 6 PRECEDING)"


@query("whole_rolling", _sql(**{op: f"CASE WHEN count(v) OVER {_SEVEN} = 7 THEN {f}(v) OVER {_SEVEN} END" for op, f in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"))}))
def _(t):
    made = {op: lambda w, op=op: W.rolling(op, "v", 7, w) for op in ("mean", "sum", "min", "max")}
    return _out(scans.framed(_gaps(t), made, [], ORDER, before=6), *made)


@query("whole_steps", _sql(diff=f"v - lag(v) OVER ({_BY})", change=f"(v - lag(v) OVER ({_BY})) / nullif(lag(v) OVER ({_BY}), 0)", back=f"lag(v, 3) OVER ({_BY})", ahead=f"lead(v, 2) OVER ({_BY})", middle=f"quantile_cont(v, 0.5) OVER ({_BY} ROWS 4 PRECEDING)"))
def _(t):
    made = {"diff": lambda w: W.diff("v", w), "change": lambda w: W.pct_change("v", w), "back": lambda w: W.shift("v", 3, w), "ahead": lambda w: W.shift("v", -2, w), "middle": lambda w: W.median_filter("v", 5, w)}
    return _out(scans.framed(_gaps(t), made, [], ORDER, before=4, after=2), *made)


@query("whole_peaks", f"SELECT {_ID} FROM (SELECT *, l_extendedprice > lag(l_extendedprice) OVER w AND l_extendedprice > lead(l_extendedprice) OVER w AS p FROM lineitem WINDOW w AS ({_BY})) WHERE p")
def _(t):
    return scans.framed(t("lineitem").select(*ORDER), {"p": lambda w: W.is_peak("l_extendedprice", w)}, [], ORDER, 1, 1).where("p").select("l_orderkey", "l_linenumber", "l_partkey")


for _method, _f in (("forward", f"last_value(v IGNORE NULLS) OVER {_ALL}"), ("backward", f"first_value(v IGNORE NULLS) OVER ({_BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")):
    @query(f"whole_{_method}_fill", _sql(out=_f))
    def _(t, method=_method):
        return _out(scans.filled(_gaps(t), "v", "out", [], ORDER, method), "out")


@query("whole_interpolate", f"""
WITH n AS (SELECT *, row_number() OVER ({_BY}) AS i FROM {_GAPS}), f AS (
  SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, first_value(v IGNORE NULLS) OVER b AS v1, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS p0, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS p1
  FROM n WINDOW a AS (ORDER BY i ROWS UNBOUNDED PRECEDING), b AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
) SELECT {_ID}, round(coalesce(v, v0 + (v1 - v0) * (i - p0) / nullif(p1 - p0, 0), v0, v1) + {_OFF_TIES}, 6) AS out FROM f""")
def _(t):
    return _out(scans.filled(_gaps(t), "v", "out", [], ORDER, "linear"), "out")


@query("whole_ewm_mean", f"""
SELECT {_ID}, CASE WHEN v IS NOT NULL THEN round(list_reduce(list_filter(l, lambda x: x IS NOT NULL), lambda a, x: a * (2.0 / 3)::DOUBLE + x * (1.0 / 3)::DOUBLE) + {_OFF_TIES}, 6) END AS out
FROM (SELECT *, list(v::DOUBLE) OVER ({_BY} ROWS 200 PRECEDING) AS l FROM {_GAPS})  -- what lies further back weighs less than rounding""")
def _(t):
    return _out(scans.ewm_mean(_gaps(t), "v", 5, "out", [], ORDER), "out")


_RANKS = {"dense": "dense_rank() OVER (ORDER BY v)", "min": "rank() OVER (ORDER BY v)", "max": "rank() OVER (ORDER BY v) + count(*) OVER (PARTITION BY v) - 1", "average": "rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2"}
for _method, _f in _RANKS.items():
    @query(f"whole_rank_{_method}", f"SELECT {_ID}, CAST({_f} AS DOUBLE) AS out FROM {_GAPS} WHERE v IS NOT NULL UNION ALL SELECT {_ID}, NULL FROM {_GAPS} WHERE v IS NULL")
    def _(t, method=_method):
        return scans.rank(_gaps(t), "v", "out", [], method).select("l_orderkey", "l_linenumber", "l_partkey", "out")


@query("whole_qcut", f"SELECT {_ID}, CAST(floor((row_number() OVER (ORDER BY v, {', '.join(ORDER)}) - 1) * 10 / count(*) OVER ()) AS INTEGER) AS bin FROM {_GAPS} WHERE v IS NOT NULL UNION ALL SELECT {_ID}, NULL FROM {_GAPS} WHERE v IS NULL")
def _(t):
    return scans.qcut(_gaps(t), "v", 10, "bin", ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "bin")
