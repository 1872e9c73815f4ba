"""Models over numeric columns: Spark's estimators in one pipeline, scaling as expressions, and measures of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import running


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation, 0 without any, from one small aggregate."""
    ends = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    made = {c: F.when(F.col(f"__s_{c}") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")) for c in columns}
    return df.join(F.broadcast(ends)).withColumns(made).select(df.columns)


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / interquartile range, 0 without any."""
    ends = running.quantile_row(df, columns, [0.25, 0.5, 0.75]).select(*(F.col(c).alias(f"__q_{c}") for c in columns))
    wide = lambda c: F.col(f"__q_{c}")[2] - F.col(f"__q_{c}")[0]
    made = {c: F.when(wide(c) == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"__q_{c}")[1]) / wide(c)) for c in columns}
    return df.join(F.broadcast(ends)).withColumns(made).select(df.columns)


def impute(df: DataFrame, columns: list[str], by: str = "mean") -> DataFrame:
    """Unknown values filled by the column's mean or median."""
    if by == "median":
        ends = running.quantile_row(df, columns, [0.5]).select(*(F.col(c)[0].alias(f"__{c}") for c in columns))
    else:
        ends = df.agg(*(F.avg(c).alias(f"__{c}") for c in columns))
    return df.join(F.broadcast(ends)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in columns}).select(df.columns)


def target_means(df: DataFrame, column: str, target: str) -> DataFrame:
    """df with {column}_target: the target's mean over the rows with the same value."""
    means = df.groupBy(F.col(column).alias("__c")).agg(F.avg(target).alias(f"{column}_target"))
    return df.join(means, F.col(column).eqNullSafe(F.col("__c")), "left").drop("__c")


ESTIMATORS = {
    "linear": ("regression", "LinearRegression", {"standardization": False}),
    "ridge": ("regression", "LinearRegression", {"standardization": False, "regParam": 0.1, "elasticNetParam": 0.0}),
    "lasso": ("regression", "LinearRegression", {"standardization": False, "regParam": 0.1, "elasticNetParam": 1.0}),
    "elastic_net": ("regression", "LinearRegression", {"standardization": False, "regParam": 0.1, "elasticNetParam": 0.5}),
    "tree_regression": ("regression", "DecisionTreeRegressor", {"seed": 1}),
    "forest_regression": ("regression", "RandomForestRegressor", {"seed": 1}),
    "logistic": ("classification", "LogisticRegression", {}),
    "naive_bayes": ("classification", "NaiveBayes", {"modelType": "gaussian"}),
    "tree": ("classification", "DecisionTreeClassifier", {"seed": 1}),
    "forest": ("classification", "RandomForestClassifier", {"seed": 1}),
    "boosted_trees": ("classification", "GBTClassifier", {"seed": 1}),
    "boosted_trees_regression": ("regression", "GBTRegressor", {"seed": 1}),
    "neural_net": ("classification", "MultilayerPerceptronClassifier", {"seed": 1, "maxIter": 200}),
    "factorization": ("classification", "FMClassifier", {"seed": 1}),
    "linear_svm": ("classification", "LinearSVC", {}),
    "kmeans": ("clustering", "KMeans", {"seed": 1}),
    "bisecting_kmeans": ("clustering", "BisectingKMeans", {"seed": 1}),
    "gaussian_mixture": ("clustering", "GaussianMixture", {"seed": 1}),
}


def fit(df: DataFrame, kind: str, features: list[str], label: str | None = None, **settings):
    """A fitted pipeline of the kind (a key of ESTIMATORS, or one_vs_rest_ and one that tells two classes apart); rows with an
    unknown feature are skipped."""
    import importlib

    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from pyspark.ml.classification import OneVsRest

    one_vs_rest = kind.startswith("one_vs_rest_")
    module, name, defaults = ESTIMATORS[kind.removeprefix("one_vs_rest_")]
    given = {**defaults, **settings, "featuresCol": "__features", **({} if label is None else {"labelCol": label})}
    estimator = getattr(importlib.import_module(f"pyspark.ml.{module}"), name)(**given)
    if one_vs_rest:
        estimator = OneVsRest(classifier=estimator, featuresCol="__features", labelCol=label)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="skip"), estimator]).fit(df)


def fit_ridge(df: DataFrame, features: list[str], label: str, penalty: float):
    """A linear model with the least sum of the mean squared error and penalty times the squared weights. Spark's own
    parameter counts in deviations of the label, so it is given times that."""
    spread = df.select(*features, label).na.drop().agg(F.stddev_pop(label)).first()[0]
    return fit(df, "ridge", features, label, regParam=penalty * (spread or 1.0), solver="normal")


def save(model, path: str) -> None:
    """Writes a fitted pipeline to a folder that all executors share; what is there is replaced."""
    model.write().overwrite().save(path)


def load(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def predict(df: DataFrame, model) -> DataFrame:
    """df with prediction."""
    return model.transform(df).select(*df.columns, F.col("prediction").cast("double").alias("prediction"))


def principal_components(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """df with pc_0 to pc_{k-1} of the centred columns. Of each direction the largest part is positive, so that its sign is
    the same in every run."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    steps = [VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip"), StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False), PCA(k=k, inputCol="__c", outputCol="__p")]
    model = Pipeline(stages=steps).fit(df)
    parts = model.stages[2].pc.toArray()
    signs = [1.0 if parts[abs(parts[:, i]).argmax(), i] > 0 else -1.0 for i in range(k)]
    out = model.transform(df).withColumn("__p", vector_to_array("__p"))
    return out.select(*df.columns, *((signs[i] * F.col("__p")[i]).alias(f"pc_{i}") for i in range(k)))


def quantile_transform(df: DataFrame, c: str, out: str) -> DataFrame:
    """The share of the known values that lie below each value, ties at their middle: from 0 to 1, evenly spread."""
    ranks = running.average_ranks(df, c)
    n = df.agg(F.count(c).alias("__n"))
    made = df.join(ranks.withColumnRenamed(c, "__v"), F.col(c) == F.col("__v"), "left").join(F.broadcast(n))
    return made.withColumn(out, F.when(F.col("__n") > 1, (F.col("rank") - 1) / (F.col("__n") - 1)).otherwise(F.when(F.col("rank").isNotNull(), F.lit(0.5)))).select(*df.columns, out)


def best_features(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, f): how far the label's groups lie apart in each column, by one-way analysis of variance; most first."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))
    long = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.explode(cells).alias("c")).select("y", "c.*").where("x is not null")
    g = long.groupBy("column", "y").agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("w"))
    n, m = F.col("n"), F.col("m")
    s = g.groupBy("column").agg(F.count("*").alias("k"), F.sum("n").alias("t"), F.sum("w").alias("w"), (F.sum(n * m * m) - F.pow(F.sum(n * m), F.lit(2)) / F.sum("n")).alias("b"))
    f = F.try_divide(F.col("b") / F.nullif(F.col("k") - 1, F.lit(0)), F.col("w") / (F.col("t") - F.col("k")))
    return s.select("column", f.alias("f")).orderBy(F.desc_nulls_last("f"), "column")


def select_k_best(df: DataFrame, columns: list[str], label: str, k: int) -> list[str]:
    return [r["column"] for r in best_features(df, columns, label).limit(k).collect()]


def uncorrelated(df: DataFrame, columns: list[str], most: float = 0.95) -> list[str]:
    """The columns, from the first on, that correlate with none kept before by more than `most`."""
    from gridloom.operators.aggregate import correlations

    pairs = {(r["a"], r["b"]): abs(r["corr"]) for r in correlations(df, columns).collect()}
    kept: list[str] = []
    for c in columns:
        if all(pairs.get((k, c), 0.0) <= most for k in kept):
            kept.append(c)
    return kept


def regression_measures(y: str, p: str) -> list[Column]:
    """mse, rmse, mae and r2 as aggregates."""
    off = F.col(y) - F.col(p)
    return [F.avg(off * off).alias("mse"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"), (1 - F.try_divide(F.avg(off * off), F.var_pop(y))).alias("r2")]


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """(actual, predicted, n)."""
    return df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))


def class_measures(y: Column, p: Column) -> list[Column]:
    """accuracy, precision, recall and f1 of two boolean columns, as aggregates."""
    hit, said, real = F.count_if(y & p), F.count_if(p), F.count_if(y)
    return [F.avg((y == p).cast("double")).alias("accuracy"), F.try_divide(hit, said).alias("precision"), F.try_divide(hit, real).alias("recall"), F.try_divide(2 * hit, said + real).alias("f1")]


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - least) / (greatest - least), 0 without any difference."""
    ends = df.agg(*(f(c).cast("double").alias(f"__{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))))
    made = {c: F.when(F.col(f"__a_{c}") == F.col(f"__b_{c}"), F.lit(0.0)).otherwise((F.col(c) - F.col(f"__a_{c}")) / (F.col(f"__b_{c}") - F.col(f"__a_{c}"))) for c in columns}
    return df.join(F.broadcast(ends)).withColumns(made).select(df.columns)


def yeo_johnson(x: Column, power: float) -> Column:
    """The power transform for numbers of either sign."""
    up = F.log1p(x) if power == 0 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if power == 2 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(F.when(x.isNotNull(), down))


def row_norm(columns: list[str], kind: str = "l2") -> Column:
    """A row's length over its columns."""
    xs = [F.col(c).cast("double") for c in columns]
    return sum((F.abs(x) for x in xs), F.lit(0.0)) if kind == "l1" else F.sqrt(sum((x * x for x in xs), F.lit(0.0)))


def varying(df: DataFrame, columns: list[str], above: float = 0.0) -> list[str]:
    """The columns whose population variance exceeds a bound."""
    found = df.agg(*(F.var_pop(c).alias(c) for c in columns)).first()
    return [c for c in columns if found[c] is not None and found[c] > above]


def mutual_information(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, information) in nats between each column of few values and the label, from joint counts; most first."""
    long = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("x")) for c in columns))).alias("s"))
    n = long.select("s.*", "y").where(F.col("x").isNotNull()).groupBy("column", "x", "y").agg(F.count("*").cast("double").alias("xy"))
    total = lambda *keys: F.sum("xy").over(Window.partitionBy("column", *keys))
    part = F.col("xy") / total() * F.log(F.col("xy") * total() / (total("x") * total("y")))
    return n.withColumn("__p", part).groupBy("column").agg(F.sum("__p").alias("information")).orderBy(F.desc("information"), "column")


def cross_validate(df: DataFrame, kind: str, features: list[str], label: str, key: str, k: int, measures: list[Column], seed: int = 0, **settings) -> DataFrame:
    """A row of the measures (aggregates over label and prediction) for each of k folds, held out in turn."""
    from gridloom.operators import rows

    dealt = df.withColumn("fold", rows.fold(key, k, seed))
    out = None
    for i in range(k):
        model = fit(dealt.where(F.col("fold") != i), kind, features, label, **settings)
        one = predict(dealt.where(F.col("fold") == i), model).agg(F.lit(i).alias("fold"), *measures)
        out = one if out is None else out.union(one)
    return out


def permutation_importance(df: DataFrame, model, features: list[str], key: str, measure: Column, seed: int = 0) -> DataFrame:
    """(feature, drop): how far a measure of the predictions falls when a feature's values move to other rows.

    Rows are numbered twice, by key and by chance, within buckets of the key's hash, and take each other's value.
    """
    from gridloom.operators import rows

    whole = predict(df, model).agg(measure.alias("m")).first()["m"]
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(max(1, df.count() // 1000)))
    marked = df.withColumn("__b", bucket)
    w = Window.partitionBy("__b")
    out = None
    for f in features:
        given = marked.select("__b", F.col(f).alias("__v"), F.row_number().over(w.orderBy(rows.by_chance(key, seed + 1), key)).alias("__n"))
        moved = marked.withColumn("__n", F.row_number().over(w.orderBy(key))).join(given, ["__b", "__n"]).withColumn(f, F.col("__v")).select(df.columns)
        one = predict(moved, model).agg(F.lit(f).alias("feature"), (F.lit(whole) - measure).alias("drop"))
        out = one if out is None else out.union(one)
    return out


def log_loss(y: str, p: str) -> Column:
    """Of labels 0 and 1 and the probability of 1."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.avg(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))


def brier(y: str, p: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), F.lit(2)))


def matthews(y: Column, p: Column) -> Column:
    """The correlation of two boolean columns; null if one never varies."""
    tp, fp, fn, tn = (F.count_if(c).cast("double") for c in (y & p, ~y & p, y & ~p, ~y & ~p))
    return F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def kappa(df: DataFrame, y: str, p: str) -> DataFrame:
    """(kappa): agreement beyond what the margins give by chance, from the table of counts."""
    n = confusion(df, y, p)
    actual, said = n.groupBy(F.col("actual").alias("c")).agg(F.sum("n").alias("a")), n.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("p"))
    chance = actual.join(said, "c").agg(F.sum(F.col("a").cast("double") * F.col("p")).alias("e"))
    same = n.agg(F.sum("n").cast("double").alias("t"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("o"))
    t, e, o = F.col("t"), F.coalesce("e", F.lit(0.0)) / (F.col("t") * F.col("t")), F.col("o") / F.col("t")
    return same.join(F.broadcast(chance)).select(F.try_divide(o - e, 1 - e).alias("kappa"))


def ndcg(df: DataFrame, keys: list[str], gain: str, score: str, tie: str, k: int) -> DataFrame:
    """(keys, ndcg) of the k best scores of each key; null where nothing gains."""
    w = Window.partitionBy(*keys)
    at, ideal = F.row_number().over(w.orderBy(F.desc(score), tie)), F.row_number().over(w.orderBy(F.desc(gain), tie))
    of = lambda r: F.sum(F.when(F.col(r) <= k, (F.pow(F.lit(2.0), F.col(gain)) - 1) / F.log2(F.col(r) + 1)).otherwise(0.0))
    return df.withColumns({"__at": at, "__ideal": ideal}).groupBy(*keys).agg(F.try_divide(of("__at"), of("__ideal")).alias("ndcg"))


def silhouette(df: DataFrame, features: list[str], prediction: str = "prediction") -> float:
    """Of squared distances, in one pass over sums a cluster holds."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=features, outputCol="__v", handleInvalid="skip").transform(df)
    return ClusteringEvaluator(featuresCol="__v", predictionCol=prediction).evaluate(made)


def grid_search(df: DataFrame, kind: str, features: list[str], label: str, key: str, k: int, measure: Column, grid: dict[str, list], most: int | None = None, seed: int = 0) -> DataFrame:
    """(settings, score), best first: the measure's mean over k folds for each combination of settings, the greater the
    better. With `most`, so many combinations, chosen by chance."""
    import json
    import random
    from itertools import product

    names = sorted(grid)
    combos = list(product(*(grid[n] for n in names)))
    if most is not None and most < len(combos):
        combos = random.Random(seed).sample(combos, most)
    out = None
    for values in combos:
        settings = dict(zip(names, values, strict=True))
        one = cross_validate(df, kind, features, label, key, k, [measure.alias("score")], seed, **settings).agg(F.lit(json.dumps(settings)).alias("settings"), F.avg("score").alias("score"))
        out = one if out is None else out.union(one)
    return out.orderBy(F.desc("score"), "settings")


def learning_curve(df: DataFrame, kind: str, features: list[str], label: str, key: str, shares: list[float], measure: Column, seed: int = 0, **settings) -> DataFrame:
    """(share, score): the measure on a fifth of the rows that is held out, by models of growing shares of the others."""
    from gridloom.operators import rows

    train, test = rows.train_test_split(df, 0.2, key, seed)
    n, out = train.count(), None
    for share in shares:
        model = fit(rows.sample(train, round(n * share), key, seed + 1), kind, features, label, **settings)
        one = predict(test, model).agg(F.lit(float(share)).alias("share"), measure.alias("score"))
        out = one if out is None else out.union(one)
    return out
