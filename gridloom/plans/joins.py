"""Queries over joins."""

from pyspark.sql import functions as F

from gridloom.operators import joins as J
from gridloom.registry import query

_RICH = "(SELECT c_custkey, c_name, c_nationkey FROM customer)"
#: Keys are moved on, so that either side has rows without a partner.
_BIG = "(SELECT o_orderkey, o_custkey + 100 AS o_custkey, o_totalprice FROM orders)"


def _sides(t):
    return t("customer").select("c_custkey", "c_name", "c_nationkey"), t("orders").select("o_orderkey", (F.col("o_custkey") + 100).alias("o_custkey"), "o_totalprice")


for how, sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    @query(f"merge_{how}", f"SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, c_nationkey, o_orderkey, o_custkey, o_totalprice FROM {_RICH} c {sql} {_BIG} o ON c_custkey = o_custkey")
    def _(t, how=how):
        return J.merge(*_sides(t), ["c_custkey"], ["o_custkey"], how).select("c_custkey", "c_name", "c_nationkey", "o_orderkey", "o_custkey", "o_totalprice")


@query("merge_indicator", f"""
SELECT CASE WHEN c_custkey IS NULL THEN 'right_only' WHEN o_custkey IS NULL THEN 'left_only' ELSE 'both' END AS _merge, count(*) AS n FROM {_RICH} c FULL JOIN {_BIG} o ON c_custkey = o_custkey GROUP BY 1""")
def _(t):
    return J.merge(*_sides(t), ["c_custkey"], ["o_custkey"], "outer", indicator=True).groupBy("_merge").agg(F.count("*").alias("n"))


@query("merge_suffix", "SELECT a.n_regionkey, a.n_name, b.n_name AS n_name_y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def _(t):
    return J.merge(t("nation").select("n_regionkey", "n_name"), t("nation").select("n_regionkey", "n_name"), ["n_regionkey"])


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey + 100 FROM orders)")
def _(t):
    return J.semi_join(t("customer"), _sides(t)[1], "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("anti_join", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o_custkey + 100 = c_custkey)")
def _(t):
    return J.anti_join(t("customer"), _sides(t)[1], "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("star_revenue_by_nation", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(t):
    df = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("as_of_last_purchase", """
WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view')
SELECT v.event_id, v.user_id, (SELECT arg_max(p.value, (p.ts, p.event_id)) FROM p WHERE p.user_id = v.user_id AND p.ts <= v.ts) AS value_as_of FROM v""")
def _(t):
    e = t("events").select("user_id", "ts", "event_id", "value", "event_type")
    views = e.where("event_type = 'view'").select("user_id", "ts", "event_id")
    return J.as_of(views, e.where("event_type = 'purchase'"), "user_id", "ts", "value", "event_id").select("event_id", "user_id", "value_as_of")
