"""Queries over rows: order, duplicates, samples, sets."""

from pyspark.sql import functions as F

from gridloom.operators import rows as R
from gridloom.registry import query


@query("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return R.sort_by(t("orders"), "o_totalprice", False, ("o_orderkey",)).limit(20).select("o_orderkey", "o_totalprice")


@query("tail_orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 15")
def _(t):
    return R.tail(t("orders"), 15, ["o_orderkey"]).select("o_orderkey")


@query("dedup_first", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def _(t):
    return R.drop_duplicates(t("events").select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("duplicated", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n > 1")
def _(t):
    return t("events").select("event_id", R.duplicated(["user_id"], ["event_id"]).alias("again")).where("again").select("event_id")


@query("union_keys", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("intersect_keys", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("except_keys", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").select("o_custkey"))


@query("unpivot_part", "SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def _(t):
    df = t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return df.unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "v")
