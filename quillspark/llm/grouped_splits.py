"""Splits that keep rows together which share an entity, directly or through other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.operators.joins import skew_join
from quillspark.runtime import materialize

#: Groups with more than this share of the rows (at most 50 of them) are placed one by one, all others by hash.
LARGE_SHARE = 0.02


def linked_rows(df: DataFrame, row: str, *entities: str) -> DataFrame:
    """(row, group_id): rows hang together when they share a value of an entity column; group_id is the smallest row id.

    Null entities join nothing; a row with nulls only is a group of its own. Row ids must be unique and not null; copied
    rows under one id count once. Rows are first tied to the smallest row of each entity by a combining aggregation, so
    the components run over distinct entity pairs and no entity's rows are gathered.
    """
    rows = materialize(df.where(F.col(row).isNotNull()).select(F.col(row).cast("bigint").alias("row"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(entities)]).distinct(), "linked-rows")
    tied = rows
    for k in range(len(entities)):
        least = rows.where(F.col(f"_{k}").isNotNull()).groupBy(f"_{k}").agg(F.min("row").alias(f"_r{k}"))
        tied = materialize(skew_join(tied, least, f"_{k}", "left"), "tied-rows")
    # the first entity's smallest row stands for the row; an edge ties it to those of the other entities
    first, *others = [F.coalesce(F.col(f"_r{k}"), F.col("row")) for k in range(len(entities))]
    edges = tied.select(first.alias("u"), F.explode(F.array(*others)).alias("v")) if others else tied.select(first.alias("u"), first.alias("v"))
    roots = components(edges, "u", "v")
    out = tied.select("row", first.alias("node")).distinct()
    out = out.join(roots, "node", "left").select("row", F.coalesce("component", "node").alias("group_id"))
    return out.groupBy("row").agg(F.min("group_id").alias("group_id")).withColumnRenamed("row", row)


def torn_groups(groups: DataFrame, labels: DataFrame, row: str, split: str) -> DataFrame:
    """Rows of the groups whose rows carry at least two different non-null splits, rows with null split included."""
    both = groups.join(labels.select(row, F.col(split).alias("_s")), row)
    torn = both.groupBy("group_id").agg(F.min("_s").alias("a"), F.max("_s").alias("b")).where("a <> b").select("group_id")
    return groups.join(torn, "group_id", "left_semi").select(row, "group_id")


def assign_splits(groups: DataFrame, row: str, shares: dict[str, float]) -> DataFrame:
    """(row, group_id, split): each group goes whole to one split, so that the splits get about the given shares of rows.

    Groups of more than LARGE_SHARE of the rows go, largest first, to the split that lacks most; the others by the hash of
    their id, over ranges in proportion to what the splits still lack.
    """
    groups = materialize(groups, "split-groups")
    sizes = groups.groupBy("group_id").count()
    total = groups.count()
    large = sizes.where(F.col("count") > LARGE_SHARE * total).orderBy(F.desc("count"), "group_id").collect()  # at most 1 / LARGE_SHARE rows
    lack, placed = {k: v * total for k, v in shares.items()}, {}
    for group, count in large:
        to = max(lack, key=lack.get)
        placed[group] = to
        lack[to] -= count
    lack = {k: max(0.0, v) for k, v in lack.items()}
    whole = sum(lack.values()) or 1.0
    at = (F.pmod(F.xxhash64("group_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30))
    edge, rule = 0.0, None
    names = list(lack)
    for k in names[:-1]:
        edge += lack[k] / whole
        rule = (F.when if rule is None else rule.when)(at < edge, k)
    rule = rule.otherwise(names[-1]) if rule is not None else F.lit(names[-1])
    if placed:
        fixed = F.create_map(*[F.lit(x) for kv in placed.items() for x in kv])
        rule = F.coalesce(fixed[F.col("group_id")], rule)
    return groups.select(row, "group_id", rule.alias("split"))
