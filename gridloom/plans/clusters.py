"""Queries of clusters: along one column, where SQL can say them by gaps."""

from gridloom.operators import clusters
from gridloom.registry import query


@query("dbscan_prices", """
WITH n AS (SELECT o_orderkey AS id, o_totalprice AS x, count(*) OVER (ORDER BY o_totalprice RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING) >= 5 AS core FROM orders),
g AS (SELECT *, CASE WHEN x - lag(x) OVER (ORDER BY x, id) <= 15 THEN 0 ELSE 1 END AS new FROM n WHERE core),
r AS (SELECT *, sum(new) OVER (ORDER BY x, id) AS run FROM g), c AS (SELECT id, x, min(id) OVER (PARTITION BY run) AS cluster FROM r),
b AS (SELECT n.id, min(c.cluster) AS cluster FROM n JOIN c ON c.x BETWEEN n.x - 15.0000000001 AND n.x + 15.0000000001 AND abs(c.x - n.x) <= 15 WHERE NOT n.core GROUP BY 1)
SELECT n.id, coalesce(c.cluster, b.cluster) AS cluster, n.core FROM n LEFT JOIN c ON n.id = c.id LEFT JOIN b ON n.id = b.id""")
def _(t):
    return clusters.dbscan(t("orders"), "o_orderkey", ["o_totalprice"], 15.0, 5)


@query("single_linkage_prices", """
WITH g AS (SELECT c_custkey AS id, c_acctbal AS x, CASE WHEN c_acctbal - lag(c_acctbal) OVER (ORDER BY c_acctbal, c_custkey) <= 9 THEN 0 ELSE 1 END AS new FROM customer),
r AS (SELECT *, sum(new) OVER (ORDER BY x, id) AS run FROM g)
SELECT id, min(id) OVER (PARTITION BY run) AS cluster FROM r""")
def _(t):
    return clusters.agglomerative(t("customer"), "c_custkey", ["c_acctbal"], distance=9.0)
