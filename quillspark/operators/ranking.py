"""Ranks, cut-offs and score scaling inside groups. Ties always go to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import materialize


def rank_order(group: str, score: str = "score", tie: str = "doc"):
    return Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))


def ranked(df: DataFrame, group: str, score: str = "score", tie: str = "doc") -> DataFrame:
    """Adds rank, from 1, by score from high to low."""
    return df.withColumn("rank", F.row_number().over(rank_order(group, score, tie)))


def top_k(df: DataFrame, group: str, k: int, score: str = "score", tie: str = "doc") -> DataFrame:
    """The best k of each group; Spark limits each task's groups before it shuffles them."""
    return ranked(df, group, score, tie).where(F.col("rank") <= k)


def max_normal(df: DataFrame, group: str, score: str) -> DataFrame:
    """Adds normal: positive scores by the group's maximum, others 0; a group without positive scores is all 0."""
    top = F.max(F.greatest(F.col(score), F.lit(0.0))).over(Window.partitionBy(group))
    return df.withColumn("normal", F.when(top > 0, F.greatest(F.col(score), F.lit(0.0)) / top).otherwise(0.0))


def minmax_normal(df: DataFrame, group: str, score: str, constant: float = 0.0, eps: float = 0.0) -> DataFrame:
    """Adds normal: scores between the group's ends; a group whose ends differ by no more than ``eps`` gets ``constant``."""
    w = Window.partitionBy(group)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("normal", F.when(hi - lo <= eps, constant).otherwise((F.col(score) - lo) / (hi - lo)))


def z_normal(df: DataFrame, group: str, score: str) -> DataFrame:
    """Adds normal: distance from the group's mean in population standard deviations; 0 if they are 0."""
    w = Window.partitionBy(group)
    sd = F.stddev_pop(score).over(w)
    return df.withColumn("normal", F.when(sd > 0, (F.col(score) - F.avg(score).over(w)) / sd).otherwise(0.0))


def margin_to(df: DataFrame, group: str, place: int = 10, score: str = "score", tie: str = "doc") -> DataFrame:
    """Adds margin: score minus the score at ``place``, or at the last place of a shorter group."""
    w = Window.partitionBy(group)
    r = ranked(df, group, score, tie).withColumn("_n", F.count(F.lit(1)).over(w))
    bar = F.max(F.when(F.col("rank") == F.least(F.lit(place), F.col("_n")), F.col(score))).over(w)
    return r.withColumn("margin", F.col(score) - bar).drop("_n")


def gap_at(df: DataFrame, group: str, place: int = 10, score: str = "score", tie: str = "doc") -> DataFrame:
    """(group, gap): difference between the scores at ``place`` and after it; null if the group is too short."""
    r = ranked(df, group, score, tie).withColumn("next", F.lead(score).over(rank_order(group, score, tie)))
    return r.groupBy(group).agg(F.max(F.when(F.col("rank") == place, F.abs(F.col(score) - F.col("next")))).alias("gap"))


def spread(columns: list[Column]) -> Column:
    """Largest minus smallest of several score columns."""
    return F.greatest(*columns) - F.least(*columns)


def numbered(df: DataFrame, *order, name: str = "number") -> DataFrame:
    """Adds ``name``, the place from 0 in the global order. Rows are sorted by a range partitioning and numbered inside their
    ranges, and only one count per range is added up, so no task gets the whole table."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    parts = materialize(parts, "numbered")
    before = F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.groupBy("_range").count().select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    return parts.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")
