"""Ranking quality over judged rows, comparisons of methods, and statistics of scores and labels.

Judged rows are (method, query_id, doc, score, gain, negative): gain is null for an unjudged document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dcg(gain: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, gain / F.log2(rank + 1.0)).otherwise(0.0))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def per_query(rows: DataFrame, k: int = 10, positive: float = 0.5, ideal: str = "all") -> DataFrame:
    """One row per method and query with every metric at cut-off k.

    A document is relevant from ``positive`` gain. Unjudged documents have gain 0. The ideal order is taken over all rows
    of the query, or with ideal="top" over the retrieved k only. Queries without relevant documents get 0 everywhere.
    """
    by = ["method", "query_id"]
    g = F.coalesce("gain", F.lit(0.0))
    r = rows.withColumn("g", g).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc")))
    kept = r if ideal == "all" else r.where(F.col("rank") <= k)
    r = kept.withColumn("best", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("g"), "doc")))
    rel, neg, top = F.col("g") >= positive, F.coalesce("negative", F.lit(False)), F.col("rank") <= k
    hit = F.sum((rel & top).cast("double"))
    expo = F.pow(F.lit(2.0), F.col("g")) - 1.0
    size = F.sum(top.cast("double"))
    return r.groupBy(*by).agg(
        _ratio(hit, F.sum(rel.cast("double"))).alias("recall"),
        (hit / float(k)).alias("precision"),
        F.coalesce(1.0 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(1.0 / F.min(F.when(rel & top, F.col("rank"))), F.lit(0.0)).alias("mrr_at_k"),
        _ratio(_dcg(rel.cast("double"), F.col("rank"), k), _dcg(rel.cast("double"), F.col("best"), k)).alias("ndcg_binary"),
        _ratio(_dcg(F.col("g"), F.col("rank"), k), _dcg(F.col("g"), F.col("best"), k)).alias("ndcg_linear"),
        _ratio(_dcg(expo, F.col("rank"), k), _dcg(expo, F.col("best"), k)).alias("ndcg_exponential"),
        _ratio(F.sum((neg & top).cast("double")), size).alias("negative_share"),
        (F.sum((neg & top).cast("double")) / float(k)).alias("negatives_per_k"),
        F.sum((F.col("gain").isNotNull() & top).cast("int")).alias("judged"),
        F.sum((F.col("gain").isNull() & top).cast("int")).alias("unjudged"),
    )


def macro_average(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, population deviation, least and most of each metric over the queries, one row per method and metric."""
    long = metrics.select("method", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])))
    return long.groupBy("method", "metric").agg(F.count("value").alias("queries"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"), F.min("value").alias("least"), F.max("value").alias("most"))


def deltas(metrics: DataFrame, column: str, baseline: str) -> DataFrame:
    """(method, query_id, value, base, delta): each method against the baseline, query by query."""
    base = metrics.where(F.col("method") == baseline).select("query_id", F.col(column).alias("base"))
    return metrics.where(F.col("method") != baseline).join(base, "query_id").select("method", "query_id", F.col(column).alias("value"), "base", (F.col(column) - F.col("base")).alias("delta"))


def wins(delta: DataFrame, eps: float = 1e-12, severe: float = -0.05) -> DataFrame:
    """Wins, losses, ties and severe losses per method, and the mean change without its best query."""
    d = F.col("delta")
    return delta.groupBy("method").agg(
        F.sum((d > eps).cast("int")).alias("wins"),
        F.sum((d < -eps).cast("int")).alias("losses"),
        F.sum((F.abs(d) <= eps).cast("int")).alias("ties"),
        F.sum((d <= severe).cast("int")).alias("severe"),
        F.avg(d).alias("mean_delta"),
        F.when(F.count(d) > 1, (F.sum(d) - F.max(d)) / (F.count(d) - 1)).alias("without_best"),
    )


def without_one(delta: DataFrame) -> DataFrame:
    """(method, query_id, mean_without): mean change of the other queries."""
    w = Window.partitionBy("method")
    n, total = F.count("delta").over(w), F.sum("delta").over(w)
    return delta.select("method", "query_id", F.when(n > 1, (total - F.col("delta")) / (n - 1)).alias("mean_without"))


def top_overlap(rows: DataFrame, left: str, right: str, k: int = 10) -> DataFrame:
    """(query_id, both, left_only, right_only, jaccard) of two methods' top k; two empty sets have 1."""
    r = rows.withColumn("rank", F.row_number().over(Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)
    by = r.groupBy("query_id", "doc").agg(F.max((F.col("method") == left).cast("int")).alias("l"), F.max((F.col("method") == right).cast("int")).alias("r")).where("l + r > 0")
    c = by.groupBy("query_id").agg(F.sum(F.col("l") * F.col("r")).alias("both"), F.sum(F.col("l") * (1 - F.col("r"))).alias("left_only"), F.sum((1 - F.col("l")) * F.col("r")).alias("right_only"))
    return c.withColumn("jaccard", F.col("both") / (F.col("both") + F.col("left_only") + F.col("right_only")))


def moves(rows: DataFrame, left: str, right: str, k: int = 10) -> DataFrame:
    """(query_id, doc, kind, gain, negative): documents that only one of the two methods has in its top k; promoted by the
    right one or demoted from the left one's."""
    r = rows.withColumn("rank", F.row_number().over(Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)
    by = r.groupBy("query_id", "doc").agg(F.max((F.col("method") == left).cast("int")).alias("l"), F.max((F.col("method") == right).cast("int")).alias("r"), F.max("gain").alias("gain"), F.max(F.coalesce("negative", F.lit(False))).alias("negative"))
    return by.where("l + r = 1").select("query_id", "doc", F.when(F.col("r") == 1, "promoted").otherwise("demoted").alias("kind"), "gain", "negative")


def pair_accuracy(rows: DataFrame, positive: float = 0.5) -> DataFrame:
    """(method, pairs, right): relevant against negative documents of one query, and how often the relevant one scores
    higher. Counted from ranks inside the query by running sums, without forming the pairs."""
    good, bad = F.coalesce("gain", F.lit(0.0)) >= positive, F.coalesce("negative", F.lit(False))
    r = rows.select("method", "query_id", "score", good.alias("good"), (bad & ~good).alias("bad")).where("good or bad")
    by = r.groupBy("method", "query_id", "score").agg(F.sum(F.col("good").cast("long")).alias("p"), F.sum(F.col("bad").cast("long")).alias("n"))
    below = Window.partitionBy("method", "query_id").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("method", "query_id")
    x = by.select("method", (F.col("p") * F.sum("n").over(all_)).alias("pairs"), (F.col("p") * F.coalesce(F.sum("n").over(below), F.lit(0))).alias("right"))
    return x.groupBy("method").agg(F.sum("pairs").alias("pairs"), F.sum("right").alias("right"))


def oracle_gap(metrics: DataFrame, column: str) -> DataFrame:
    """(query_id, best_method, best, worst, gap): ties go to the smaller method name."""
    return metrics.groupBy("query_id").agg(F.min_by("method", F.struct((-F.col(column)).alias("v"), "method")).alias("best_method"), F.max(column).alias("best"), F.min(column).alias("worst")).withColumn("gap", F.col("best") - F.col("worst"))


def nearest_rank(df: DataFrame, group: str, column: str, shares: list[float]) -> DataFrame:
    """(group, share, value): the value at place round(share * (n - 1)), halves to even, of the sorted values. Places come
    from row numbers, so no group is collected."""
    w = Window.partitionBy(group).orderBy(column)
    r = df.where(F.col(column).isNotNull()).select(group, column, (F.row_number().over(w) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy(group)).alias("n"))
    x = r.select(group, column, "at", "n", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"))
    return x.where(F.col("at") == F.bround(F.col("share") * (F.col("n") - 1), 0)).select(group, "share", F.col(column).alias("value"))


def calibration(rows: DataFrame, score: str, gain: str, bins: int = 5) -> DataFrame:
    """(bin, n, mean_score, mean_gain): equal bins from 0 to 1; empty ones are there with zeros."""
    spark = rows.sparkSession
    b = F.least(F.floor(F.greatest(F.least(F.col(score), F.lit(1.0)), F.lit(0.0)) * bins), F.lit(bins - 1))
    got = rows.where(F.col(score).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(gain).alias("mean_gain"))
    all_ = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_.join(got, "bin", "left").select("bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "mean_score", "mean_gain")])


def confusion(rows: DataFrame, score: str, gain: str, low: float = 0.33, high: float = 0.66) -> DataFrame:
    """(predicted, actual, n) of three buckets."""
    bucket = lambda c: F.when(F.col(c) >= high, 2).when(F.col(c) >= low, 1).otherwise(0)
    return rows.where(F.col(score).isNotNull() & F.col(gain).isNotNull()).groupBy(bucket(score).alias("predicted"), bucket(gain).alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def _corr(a: Column, b: Column) -> Column:
    """Correlation of the rows that have both; 0 where a side is constant. Spark's own divides by zero there, which is an error
    under its ANSI rules."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread)), F.lit(0.0))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r, strong) of every pair of columns in one pass; a constant column gives 0."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    value = lambda i: F.col(f"r{i}")
    long = one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value(i).alias("r")) for i, (a, b) in enumerate(pairs)])))
    return long.withColumn("strong", F.abs("r") >= 0.85)


def rank_correlation(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, rho): correlation of ranks, ties sharing their mean rank; degenerate groups give 0."""
    out = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c in (a, b):
        same = Window.partitionBy(group, c)
        out = out.withColumn(f"_{c}", F.rank().over(Window.partitionBy(group).orderBy(c)) + (F.count(F.lit(1)).over(same) - 1) / 2.0)
    return out.groupBy(group).agg(_corr(F.col(f"_{a}"), F.col(f"_{b}")).alias("rho"))


def summary(rows: DataFrame, group: str, column: str) -> DataFrame:
    """Count, nulls, least, most, mean and population deviation per group."""
    c = F.col(column)
    return rows.groupBy(group).agg(F.count(c).alias("n"), F.sum(c.isNull().cast("int")).alias("nulls"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation"))


def scope_split(rows: DataFrame, source: str) -> DataFrame:
    """Every row once under scope combined and once under its source."""
    return rows.withColumn("scope", F.explode(F.array_compact(F.array(F.lit("combined"), F.col(source)))))


def acceptance(checks: dict[str, Column]) -> Column:
    """Struct of the checks and of all of them together."""
    return F.struct(*[c.alias(n) for n, c in checks.items()], reduce(lambda a, b: a & b, checks.values()).alias("accepted"))


def bootstrap(delta: DataFrame, times: int = 500) -> DataFrame:
    """(method, mean, low, high): 5th and 95th percentile of the mean change over resampled queries. A query's weight in a
    resample is drawn from its hash (a Poisson draw), so that resampling needs no shuffle of the rows by number."""
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("146"), "query_id", "b"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]  # distribution of a Poisson count of mean 1
    weight = reduce(lambda a, b: a + b, [(u > s).cast("int") for s in steps])
    draws = delta.select("method", "query_id", "delta", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("b")).withColumn("w", weight)
    means = draws.groupBy("method", "b").agg((F.sum(F.col("w") * F.col("delta")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    return means.groupBy("method").agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.05)).alias("low"), F.percentile("m", F.lit(0.95)).alias("high"))
