"""Queries over samples, splits, folds, positions and labels of rows."""

from pyspark.sql import functions as F

from gridloom.operators import aggregate, index, rows, sampling
from gridloom.registry import query
from gridloom.sources import files


def _chance(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 15))::BIGINT"


@query("sample_exact", f"SELECT * FROM orders ORDER BY {_chance('o_orderkey', 3)}, o_orderkey LIMIT 100")
def _(t):
    return rows.sample(t("orders"), 100, "o_orderkey", seed=3)


@query("split_test", f"SELECT * FROM orders QUALIFY row_number() OVER (ORDER BY {_chance('o_orderkey', 3)}, o_orderkey) <= round((SELECT count(*) FROM orders) * 0.2)")
def _(t):
    return rows.train_test_split(t("orders"), 0.2, "o_orderkey", seed=3)[1]


@query("split_train", f"SELECT * FROM orders QUALIFY row_number() OVER (ORDER BY {_chance('o_orderkey', 3)}, o_orderkey) > round((SELECT count(*) FROM orders) * 0.2)")
def _(t):
    return rows.train_test_split(t("orders"), 0.2, "o_orderkey", seed=3)[0]


@query("folds", f"SELECT o_orderkey, CAST({_chance('o_orderkey', 0)} % 5 AS INTEGER) AS fold FROM orders")
def _(t):
    return t("orders").select("o_orderkey", rows.fold("o_orderkey", 5).alias("fold"))


@query("even_folds", f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {_chance('o_orderkey', 1)}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def _(t):
    return rows.even_folds(t("orders"), 5, "o_orderkey", seed=1).select("o_orderkey", "fold")


@query("stratified_folds", f"SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_chance('o_orderkey', 1)}, o_orderkey) - 1) % 4 AS INTEGER) AS fold FROM orders")
def _(t):
    return rows.even_folds(t("orders"), 4, "o_orderkey", seed=1, strata=["o_orderpriority"]).select("o_orderkey", "fold")


@query("time_series_splits", "SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) * 6 / (SELECT count(*) FROM events)) AS INTEGER) AS block FROM events")
def _(t):
    return rows.time_series_splits(t("events"), 5, ["ts", "event_id"]).select("event_id", "block")


@query("stratified_sample", f"""
SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_chance('c_custkey', 2)}, c_custkey) <= round(count(*) OVER (PARTITION BY c_mktsegment) * 0.1)""")
def _(t):
    return rows.stratified_sample(t("customer"), 0.1, ["c_mktsegment"], "c_custkey", seed=2).select("c_custkey", "c_mktsegment")


@query("shuffled_batches", f"SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY {_chance('c_custkey', 4)}, c_custkey) - 1) / 64) AS BIGINT) AS batch FROM customer")
def _(t):
    return files.batches(t("customer"), 64, "c_custkey", seed=4).select("c_custkey", "batch")


@query("select_rows", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), p AS (SELECT n_nationkey % 7 AS i FROM nation)
SELECT s_suppkey, s_name FROM p JOIN n USING (i)""")
def _(t):
    return rows.select_rows(t("supplier"), t("nation").select((F.col("n_nationkey") % 7).alias("position")), ["s_suppkey"]).select("s_suppkey", "s_name")


@query("reset_index", "SELECT CAST(n_regionkey AS VARCHAR) AS level_0, n_name AS level_1, n_nationkey FROM nation")
def _(t):
    return index.set_index(t("nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_name", "n_regionkey"]).swaplevel().reset_index()


@query("index_lookup", "SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 2")
def _(t):
    return index.set_index(t("nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_regionkey"]).loc("2")


@query("labels_index", "SELECT 'row ' || (row_number() OVER (ORDER BY n_name) - 1) AS label, n_nationkey FROM nation")
def _(t):
    df = t("nation").select("n_nationkey", "n_name")
    labels = df.sparkSession.range(df.count()).select(F.col("id").alias("position"), F.concat(F.lit("row "), "id").alias("label"))
    return index.set_labels_index(df, labels, ["n_name"]).df.select("label", "n_nationkey")


@query("unique_columns", "SELECT count(DISTINCT o_orderkey) = count(*) AS o_orderkey, count(DISTINCT o_custkey) = count(*) AS o_custkey FROM orders")
def _(t):
    df = t("orders")
    return df.sparkSession.createDataFrame([(index.is_unique(df, ["o_orderkey"]), index.is_unique(df, ["o_custkey"]))], "o_orderkey boolean, o_custkey boolean")


@query("systematic_resample", """
WITH n AS (SELECT c_custkey, sum(c_nationkey) OVER (ORDER BY c_custkey) AS hi, c_nationkey AS w, sum(c_nationkey) OVER ()::DOUBLE AS t FROM customer WHERE c_nationkey > 0)
SELECT c_custkey, count(*) AS n FROM n JOIN range(500) r(i) ON (i + 0.6369616873214543) / 500 * t >= hi - w AND (i + 0.6369616873214543) / 500 * t < hi GROUP BY 1""")
def _(t):
    return sampling.systematic_resample(t("customer"), "c_nationkey", ["c_custkey"], 500, seed=0).groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("importance_mean", """
SELECT round(sum(l_quantity * exp(-l_quantity / 10)) / sum(exp(-l_quantity / 10)), 6) AS mean, round(pow(sum(exp(-l_quantity / 10)), 2) / sum(exp(-l_quantity / 5)), 4) AS size FROM lineitem""")
def _(t):
    target = F.exp(-F.col("l_quantity") / 10)
    return t("lineitem").agg(F.round(sampling.importance_mean(F.col("l_quantity"), target, F.lit(1.0)), 6).alias("mean"), F.round(sampling.effective_size(target), 4).alias("size"))


@query("latin_hypercube")
def _(t):
    return sampling.latin_hypercube(t("nation").sparkSession, 200, 3, seed=5)


@query("largest_triangles")
def _(t):
    return sampling.largest_triangles(t("events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("x"), "value"), "x", "value", 100)


for name in ("sturges", "sqrt", "scott", "freedman_diaconis"):
    sql = {"sturges": "1 + ceil(log2(count(*)))", "sqrt": "ceil(sqrt(count(*)))", "scott": "ceil((max(v) - min(v)) * cbrt(count(*)) / (3.49 * stddev_samp(v)))", "freedman_diaconis": "ceil((max(v) - min(v)) * cbrt(count(*)) / (2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))))"}[name]

    @query(f"histogram_{name}", f"""
    WITH s AS (SELECT o_totalprice AS v FROM orders), e AS (SELECT min(v) AS lo, max(v) AS hi, {sql} AS bins FROM s)
    SELECT CAST(least(floor((v - lo) / ((hi - lo) / bins)), bins - 1) AS INTEGER) AS bin, count(*) AS count FROM s, e GROUP BY 1""")
    def _(t, name=name):
        return aggregate.histogram(t("orders"), "o_totalprice", name)


@query("box", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(o_totalprice) FILTER (o_totalprice >= q1 - 0.5 * (q3 - q1)) AS low, max(o_totalprice) FILTER (o_totalprice <= q3 + 0.5 * (q3 - q1)) AS high,
count(*) FILTER (o_totalprice < q1 - 0.5 * (q3 - q1) OR o_totalprice > q3 + 0.5 * (q3 - q1)) AS outliers FROM orders, q GROUP BY ALL""")
def _(t):
    return aggregate.box(t("orders"), "o_totalprice", 0.5).select(*(F.round(c, 4).alias(c) for c in ("q1", "median", "q3")), "low", "high", "outliers")
