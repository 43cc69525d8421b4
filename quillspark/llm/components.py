"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.joins import HOT_ROWS, hot_keys, split_join
from quillspark.runtime import materialize, release


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step over a table of ``total`` edges (u, v). The neighbourhood of a node is never gathered: its minimum comes
    from an aggregation that combines before the shuffle, and is joined back to the edges, those of nodes with very many
    neighbours by a broadcast of their few minima."""
    if large:
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        ways = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lows = ways.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("count")).withColumn("low", F.least("u", "low"))
    if total > HOT_ROWS:
        lows = materialize(lows, "lows")
    met = split_join(ways, lows.select("u", "low"), "u", "inner", hot_keys(lows, "u", total))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an undirected edge list of bigint ids; component is its smallest node.

    Null ends and self edges are ignored, repeated edges count once, an empty list gives no rows. Each round is written
    to the shared folder, so that a lost executor costs one round; rounds grow with the logarithm of the diameter.
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = materialize(now, "edges")
    seen, count = None, now.count()
    for _ in range(most_rounds):
        middle = _star(now, True, count)
        if count > HOT_ROWS:
            middle = materialize(middle, "edges")
        following = materialize(_star(middle, False, count), "edges")
        count, total = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(now)
        release(middle)
        now = following
        if seen == (count, total):
            break
        seen = (count, total)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
