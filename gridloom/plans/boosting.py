"""Queries of boosting; three rounds of one split each are said in SQL as well, over every value as a threshold."""

from pyspark.sql import functions as F

from gridloom.operators import boosting
from gridloom.registry import query

FEATURES = ["l_quantity", "l_discount", "l_tax"]
_UNKNOWN = "CASE WHEN l_partkey % 10 <> 3 THEN l_quantity END"


def _rounds(n: int, rate: float, penalty: float) -> str:
    sql = f"""
WITH r0 AS MATERIALIZED (SELECT row_number() OVER () AS row, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS y, {_UNKNOWN} AS x0, l_discount AS x1, l_tax AS x2, avg(l_extendedprice) OVER () AS p FROM lineitem)"""
    for i in range(n):
        sql += f""",
h{i} AS (SELECT f, x, sum(p - y) AS g, count(*) AS h FROM (SELECT p, y, unnest([0, 1, 2]) AS f, unnest([x0, x1, x2]) AS x FROM r{i}) GROUP BY 1, 2),
t{i} AS (SELECT f, x, lead(x) OVER w AS above, sum(g) OVER w AS g, sum(h) OVER w AS h, sum(g) OVER k AS gs, sum(h) OVER k AS hs FROM h{i} WHERE x IS NOT NULL WINDOW w AS (PARTITION BY f ORDER BY x), k AS (PARTITION BY f)),
m{i} AS (SELECT t.f, (x + above) / 2 AS x, side = 0 AS l, t.g + CASE WHEN side = 0 THEN coalesce(u.g, 0) ELSE 0 END AS lg, t.h + CASE WHEN side = 0 THEN coalesce(u.h, 0) ELSE 0 END AS lh, gs + coalesce(u.g, 0) AS gs, hs + coalesce(u.h, 0) AS hs
    FROM t{i} t CROSS JOIN (VALUES (0), (1)) s(side) LEFT JOIN (SELECT f, g, h FROM h{i} WHERE x IS NULL) u ON t.f = u.f WHERE above IS NOT NULL),
b{i} AS MATERIALIZED (SELECT *, -lg / (lh + {penalty}) AS wl, -(gs - lg) / (hs - lh + {penalty}) AS wr FROM m{i} ORDER BY round(lg * lg / (lh + {penalty}) + (gs - lg) * (gs - lg) / (hs - lh + {penalty}), 2) DESC, f, NOT l, x LIMIT 1),
r{i + 1} AS MATERIALIZED (SELECT r.* REPLACE (p + {rate} * CASE WHEN coalesce([x0, x1, x2][f + 1] <= b.x, b.l) THEN wl ELSE wr END AS p) FROM r{i} r, b{i} b)"""
    return sql.replace("r.* REPLACE (p", "r.row, r.l_orderkey, r.l_linenumber, r.l_partkey, r.y, r.x0, r.x1, r.x2, (p").replace("END AS p) FROM", "END) AS p FROM") + f"\nSELECT l_orderkey, l_linenumber, l_partkey, round(p, 4) AS prediction FROM r{n}"


@query("boosted_prices", _rounds(3, 0.5, 1.0))
def _(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 10 != 3, F.col("l_quantity")).alias("l_quantity"), "l_discount", "l_tax", "l_extendedprice")
    model = boosting.fit(df, FEATURES, "l_extendedprice", rounds=3, depth=1, rate=0.5, penalty=1.0)
    return model.transform(df).select("l_orderkey", "l_linenumber", "l_partkey", F.round("prediction", 4).alias("prediction"))
