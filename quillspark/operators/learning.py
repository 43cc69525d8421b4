"""Model fitting: exact ridge regression from aggregated moments, and Spark's own learners for the rest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ridge(df: DataFrame, features: list[str], label: str, penalty: float = 1.0, weight: Column | None = None, standardise: bool = True) -> dict:
    """Ridge regression with a free intercept. One pass gives the weighted moments of all features, a matrix of as many
    rows as features; only that is solved on the driver. Rows with a null label are left out, null features count 0.

    Returns intercept, coefficients (on the original scale of the features), mean, scale and rows.
    """
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features] + [F.col(label).cast("double")]
    w = weight if weight is not None else F.lit(1.0)
    rows = df.where(F.col(label).isNotNull()).select(w.alias("w"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    k = len(x)
    sums = [F.sum(F.col("w")).alias("n"), F.count(F.lit(1)).alias("rows")]
    sums += [F.sum(F.col("w") * F.col(f"x{i}")).alias(f"s{i}") for i in range(k)]
    sums += [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    m = rows.agg(*sums).first()
    if not m["rows"]:
        return {"intercept": 0.0, "coefficients": dict.fromkeys(features, 0.0), "mean": {}, "scale": {}, "rows": 0}
    n = m["n"]
    mean = np.array([m[f"s{i}"] / n for i in range(k)])
    second = np.array([[m[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(second)[:-1], 0)) if standardise else np.ones(k - 1)
    scale = np.where(scale > 1e-12, scale, 1.0)
    gram = second[:-1, :-1] * n / np.outer(scale, scale) + penalty * np.eye(k - 1)
    beta = np.linalg.pinv(gram) @ (second[:-1, -1] * n / scale) / scale
    return {"intercept": float(mean[-1] - beta @ mean[:-1]), "coefficients": dict(zip(features, beta.tolist())), "mean": dict(zip(features, mean[:-1].tolist())), "scale": dict(zip(features, scale.tolist())), "rows": int(m["rows"])}


def predict(model: dict) -> Column:
    """Prediction of a fitted linear model as a column expression."""
    total = F.lit(model["intercept"])
    for f, c in model["coefficients"].items():
        total = total + c * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    return total


def cross_predictions(df: DataFrame, fold: str, features: list[str], label: str, penalty: float = 1.0) -> DataFrame:
    """Every row with the prediction of a model fitted on the other folds. Folds are few; one model each."""
    folds = [r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().orderBy(fold).collect()]
    value = None
    for f in folds:
        model = ridge(df.where(F.col(fold) != f), features, label, penalty)
        value = F.when(F.col(fold) == f, predict(model)) if value is None else value.when(F.col(fold) == f, predict(model))
    return df.withColumn("prediction", value if value is not None else F.lit(None).cast("double"))


def fit_trees(df: DataFrame, features: list[str], label: str, kind: str = "forest", trees: int = 40, depth: int = 5, seed: int = 13):
    """A forest or boosted trees of Spark's learners; returns (model, importances by feature)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df.where(F.col(label).isNotNull()))
    learner = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed) if kind == "forest" else GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed)
    model = learner.setFeaturesCol("_x").setLabelCol(label).fit(rows)
    return model, dict(zip(features, model.featureImportances.toArray().tolist()))


def fit_errors(df: DataFrame, prediction: str, label: str, group: str) -> DataFrame:
    """(group, n, mae, rmse) of predictions."""
    e = F.col(prediction) - F.col(label)
    return df.where(F.col(prediction).isNotNull() & F.col(label).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def sample_weights(df: DataFrame, group: str) -> DataFrame:
    """Adds weight, which gives every group the same sum: rows over groups and rows of the own group. Group counts are
    aggregated and joined back, so no group is gathered."""
    own = df.groupBy(group).agg(F.count(F.lit(1)).alias("_own"))
    total = own.agg(F.sum("_own").alias("_n"))
    sized = own.crossJoin(F.broadcast(total)).select(F.col(group).alias("_g"), (F.col("_n") / F.col("_own")).alias("weight"))
    return df.join(sized, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def specs(names: list[str], label: str = "y", seed: int = 13) -> dict:
    """Learners by name over a vector column ``_x``: ridge, elastic, logistic (label from 0.5 is 1), forest, deep_forest, boosted."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    known = {
        "ridge": lambda: LinearRegression(regParam=0.01, elasticNetParam=0.0), "elastic": lambda: LinearRegression(regParam=0.01, elasticNetParam=0.5), "logistic": lambda: LogisticRegression(regParam=0.01),
        "forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed), "deep_forest": lambda: RandomForestRegressor(numTrees=40, maxDepth=8, seed=seed), "boosted": lambda: GBTRegressor(maxIter=15, maxDepth=3, seed=seed),
    }
    return {n: known[n]().setFeaturesCol("_x").setLabelCol("_b" if n == "logistic" else label).setPredictionCol("_p") for n in names}


def _assembled(df: DataFrame, features: list[str], label: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = df.where(F.col(label).isNotNull()).withColumns({f"_f{i}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for i, f in enumerate(features)})
    rows = filled.withColumns({"y": F.col(label).cast("double"), "_b": (F.col(label) >= 0.5).cast("double")})
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_x").transform(rows)


def leave_one_group_out(df: DataFrame, group: str, features: list[str], label: str, names: list[str]) -> DataFrame:
    """(model, group, doc, prediction, label): every row under models fitted on the other groups. Groups are folds of topics, few
    by their nature; each model is fitted once per group."""
    from functools import reduce

    from pyspark.ml.functions import vector_to_array

    rows = _assembled(df, features, label)
    groups = [r[0] for r in rows.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).collect()]
    out = []
    for g in groups:
        train, held = rows.where(F.col(group) != g), rows.where(F.col(group) == g)
        for n, learner in specs(names).items():
            if n == "logistic" and train.select("_b").distinct().count() < 2:
                continue
            p = learner.fit(train).transform(held)
            value = vector_to_array("probability")[1] if n == "logistic" else F.col("_p")
            out.append(p.select(F.lit(n).alias("model"), F.col(group), "doc", value.alias("prediction"), F.col("y").alias("label")))
    return reduce(DataFrame.unionByName, out) if out else rows.select(F.lit("").alias("model"), group, "doc", F.lit(0.0).alias("prediction"), F.col("y").alias("label")).limit(0)


def text_model(df: DataFrame, text: str, features: list[str], label: str, words: int = 1 << 14, penalty: float = 0.1):
    """A fitted pipeline over (text, features): hashed words and word pairs weighted by rarity, beside the scaled features, into
    a ridge regression. Its transform adds prediction."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    own = ", ".join(f"coalesce(cast({f} as double), 0.0D) AS _s{i}" for i, f in enumerate(features))
    steps = [
        SQLTransformer(statement=f"SELECT *, coalesce({text}, '') AS _text, {own} FROM __THIS__"), RegexTokenizer(inputCol="_text", outputCol="_w", pattern="[a-z0-9]+", gaps=False), NGram(inputCol="_w", outputCol="_n", n=2),
        SQLTransformer(statement="SELECT *, concat(_w, _n) AS _t FROM __THIS__"), HashingTF(inputCol="_t", outputCol="_tf", numFeatures=words), IDF(inputCol="_tf", outputCol="_idf"),
        VectorAssembler(inputCols=[f"_s{i}" for i in range(len(features))], outputCol="_sv"), StandardScaler(inputCol="_sv", outputCol="_sc"), VectorAssembler(inputCols=["_idf", "_sc"], outputCol="_x"),
        LinearRegression(featuresCol="_x", labelCol=label, regParam=penalty, predictionCol="prediction", maxIter=20, solver="l-bfgs"),
    ]
    return Pipeline(stages=steps).fit(df.where(F.col(label).isNotNull()))
