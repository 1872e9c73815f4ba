"""Queries of matrix products whose sides are both whole tables."""

from pyspark.sql import functions as F

from gridloom.operators import matrices
from gridloom.registry import query

_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query("gram_matrix", " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum({a} * {b}), 2) AS v FROM lineitem" for i, a in enumerate(_COLUMNS) for j, b in enumerate(_COLUMNS)))
def _(t):
    m = matrices.entries(t("lineitem").select(*_ORDER), _COLUMNS, _ORDER)
    return matrices.product(matrices.transposed(m), m).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("v", 2).alias("v"))


@query("orders_by_suppliers", """
WITH a AS (SELECT l_orderkey AS i, l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_partkey AS k, l_suppkey AS j, sum(l_tax) AS v FROM lineitem GROUP BY 1, 2)
SELECT a.i AS l_orderkey, b.j AS l_suppkey, round(sum(a.v * b.v), 6) AS v FROM a JOIN b USING (k) GROUP BY 1, 2 HAVING round(sum(a.v * b.v), 6) <> 0""")
def _(t):
    e = lambda i, j, v: t("lineitem").select(F.col(i).alias("i"), F.col(j).alias("j"), F.col(v).alias("v"))
    found = matrices.product(e("l_orderkey", "l_partkey", "l_quantity"), e("l_partkey", "l_suppkey", "l_tax"))
    return found.select(F.col("i").alias("l_orderkey"), F.col("j").alias("l_suppkey"), F.round("v", 6).alias("v")).where("v <> 0")
