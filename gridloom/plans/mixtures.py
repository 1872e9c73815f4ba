"""A query of a mixture, whose rounds are said in SQL one by one."""

from gridloom.operators import mixtures
from gridloom.registry import query

_ROUNDS = 4


def _sql() -> str:
    sql = "WITH p0 AS (SELECT 0.5::DOUBLE AS w0, 0.5::DOUBLE AS w1, 15.0::DOUBLE AS m0, 35.0::DOUBLE AS m1)"
    for i in range(_ROUNDS):
        sql += f""",
l{i} AS (SELECT l_quantity AS x, ln(w0) + l_quantity * ln(m0) - m0 - lgamma(l_quantity + 1) AS a, ln(w1) + l_quantity * ln(m1) - m1 - lgamma(l_quantity + 1) AS b FROM lineitem, p{i}),
r{i} AS (SELECT x, 1 / (1 + exp(b - a)) AS s FROM l{i}),
p{i + 1} AS MATERIALIZED (SELECT avg(s) AS w0, avg(1 - s) AS w1, sum(s * x) / sum(s) AS m0, sum((1 - s) * x) / sum(1 - s) AS m1 FROM r{i})"""
    return sql + f" SELECT 0 AS component, round(w0, 8) AS weight, round(m0, 6) AS rate FROM p{_ROUNDS} UNION ALL SELECT 1, round(w1, 8), round(m1, 6) FROM p{_ROUNDS}"


@query("poisson_mixture", _sql())
def _(t):
    df = t("lineitem").select("l_quantity")
    found = mixtures.em(df, mixtures.poisson("l_quantity"), [0.5, 0.5], [{"rate": 15.0}, {"rate": 35.0}], rounds=_ROUNDS, tolerance=0)
    return df.sparkSession.createDataFrame([(j, round(w, 8), round(p["rate"], 6)) for j, (w, p) in enumerate(zip(found.weights, found.parameters, strict=True))], "component int, weight double, rate double")
