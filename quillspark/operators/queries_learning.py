"""Fitted models and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import learning as L
from quillspark.operators.corpus import hash_share
from quillspark.operators.queries_evaluation import JUDGED, judged
from quillspark.runtime import load
from quillspark.streaming import incremental as S


def ridge_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """One-feature regression of gain on citations, unpenalised, so that SQL can check it; and its fit."""
    j = judged(spark, d).where("gain is not null")
    m = L.ridge(j, ["cited"], "gain", 0.0)
    return spark.createDataFrame([(round(m["coefficients"]["cited"], 6), round(m["intercept"], 6), m["rows"])], "slope double, intercept double, rows bigint")


def ridge_cross_fit(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d).where("gain is not null").withColumn("fold", F.pmod(F.xxhash64("query_id"), F.lit(3)))
    p = L.cross_predictions(j, "fold", ["cited", "recent", "long"], "gain")
    return L.fit_errors(p, "prediction", "gain", "fold").select("fold", "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


def ridge_folds(spark: SparkSession, d: str) -> DataFrame:
    """Cross-fitted one-feature ridge regression of gain on citations, folds by hash of the query."""
    j = judged(spark, d).where("gain is not null").withColumn("fold", F.floor(hash_share(5, F.col("query_id")) * 3).cast("int"))
    p = L.cross_predictions(j, "fold", ["cited"], "gain", 2.0)
    return L.fit_errors(p, "prediction", "gain", "fold").select("fold", "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


def balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weight that each label source's examples get, and their sum."""
    t = load(spark, d, "training_examples").select("example_id", "label_source")
    return L.sample_weights(t, "label_source").groupBy("label_source").agg(F.round(F.max("weight"), 6).alias("weight"), F.round(F.sum("weight"), 4).alias("total"))


def forest_importances(spark: SparkSession, d: str) -> DataFrame:
    _, imp = L.fit_trees(judged(spark, d).where("gain is not null"), ["cited", "recent", "long"], "gain", trees=10)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in imp.items()], "feature string, importance double")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("action"), "ts")


def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """An extra: tumbling windows of the event stream, here over the stored table."""
    return S.windowed_counts(_events(spark, d))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """An extra: sessions of each reader that end after half an hour without events."""
    return S.session_counts(_events(spark, d))


QUERIES = {f.__name__: f for f in (ridge_coefficients, ridge_folds, balanced_weights, ridge_cross_fit, forest_importances, hourly_events, event_sessions)}
SQL = {
    "ridge_coefficients": f"WITH {JUDGED} SELECT round(regr_slope(gain, cited), 6) AS slope, round(regr_intercept(gain, cited), 6) AS intercept, count(*) AS rows FROM judged WHERE gain IS NOT NULL",
    "ridge_folds": f"WITH {JUDGED}, j AS (SELECT *, floor(('0x' || substr(sha256('5:' || query_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE * 3)::INT AS fold FROM judged WHERE gain IS NOT NULL), m AS (SELECT f.fold, count(*) * covar_pop(gain, cited) / (count(*) + 2.0) / var_pop(cited) AS slope, avg(cited) AS mx, avg(gain) AS my FROM (SELECT DISTINCT fold FROM j) f JOIN j ON j.fold <> f.fold GROUP BY 1), e AS (SELECT j.fold, my + slope * (cited - mx) - gain AS e FROM j JOIN m USING (fold)) SELECT fold, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM e GROUP BY 1",
    "balanced_weights": "WITH x AS (SELECT label_source, sum(count(*)) OVER () / count(*) AS weight, count(*) AS n FROM training_examples GROUP BY 1) SELECT label_source, round(weight, 6)::DOUBLE AS weight, round(weight * n, 4)::DOUBLE AS total FROM x",
    "hourly_events": "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type AS action, count(*) AS n FROM events GROUP BY ALL",
    "event_sessions": "WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id AS \"user\", min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM y GROUP BY user_id, s",
}
