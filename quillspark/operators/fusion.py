"""Blends of several scores per (query_id, doc). Rows missing from a source should come with score 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.ranking import minmax_normal, rank_order

#: Weights and bounds of the guarded blend and of the swap-limited fusion.
GUARD = {"first": 0.675, "second": 0.225, "text": 0.10, "confidence": 0.85}
MAX_SWAPS, SWAP_STEP, CLIP = 2, 0.004, 0.005


def scaled(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Adds <column>_n for each column: between the group's ends, 0.5 where they are equal."""
    for c in columns:
        df = minmax_normal(df, group, c, constant=0.5, eps=1e-12).withColumnRenamed("normal", f"{c}_n")
    return df


def blend(weights: dict[str, float]) -> Column:
    """Weighted sum of columns."""
    return reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()])


def penalised(score: Column, trusted: Column, doubting: Column, amount: float = 0.20) -> Column:
    """Score less ``amount`` where a trusted score is high and a doubting one low."""
    return score - F.when((trusted >= 0.70) & (doubting <= 0.25), amount).otherwise(0.0)


def guarded(first: Column, second: Column, text: Column) -> Column:
    """Blend of two ranker scores; the text score counts only where neither ranker is confident."""
    open_ = F.greatest(first, second) < GUARD["confidence"]
    return GUARD["first"] * first + GUARD["second"] * second + F.when(open_, GUARD["text"] * text).otherwise(0.0)


def filtered_text(base: Column, text: Column, confidence: Column, mode: str, cap: float = 0.035) -> Column:
    """Text score added to a base score under one of the rules: capped, unsure, agreed or full."""
    plain = 0.10 * text
    if mode == "capped":
        return base + F.least(plain, F.lit(cap))
    if mode == "unsure":
        return base + F.when(confidence < 0.85, plain).otherwise(0.0)
    if mode == "agreed":
        return base + F.when(F.abs(text - base) >= 0.35, 0.0).otherwise(plain)
    if mode == "full":
        return base + plain
    raise ValueError(mode)


def swap_limited(df: DataFrame, group: str, base: str, other: str, k: int = 10, swaps: int = MAX_SWAPS) -> DataFrame:
    """Adds score and entrant: at most ``swaps`` documents of the other ranking's top k may enter the base top k, with a
    score little over its last one; every other document moves by no more than CLIP."""
    w = Window.partitionBy(group)
    r = df.withColumn("_b", F.row_number().over(rank_order(group, base))).withColumn("_o", F.row_number().over(rank_order(group, other)))
    r = r.withColumn("_last", F.min(F.when(F.col("_b") <= k, F.col(base))).over(w))
    new = (F.col("_o") <= k) & (F.col("_b") > k)
    order = Window.partitionBy(group).orderBy(F.when(new, F.col("_o")).asc_nulls_last())
    r = r.withColumn("entrant", new & (F.row_number().over(order) <= swaps))
    cap = F.col("_last") + SWAP_STEP * (swaps + 1)
    moved = F.greatest(F.col(base), F.least(F.col(other), cap))
    step = F.greatest(F.least(F.col(other) - F.col(base), F.lit(CLIP)), F.lit(-CLIP))
    return r.withColumn("score", F.when(F.col("entrant"), moved).otherwise(F.col(base) + step)).drop("_b", "_o", "_last")


def fusion_features(df: DataFrame, group: str, columns: list[str], k: int = 10) -> DataFrame:
    """Adds scaled scores, ranks, margins to the k-th score, and differences of the first column to each other one. Groups
    in which any score is missing give no rows."""
    w = Window.partitionBy(group)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    df = df.withColumn("_ok", F.min(whole.cast("int")).over(w)).where("_ok = 1").drop("_ok")
    df = scaled(df, group, columns)
    for c in columns:
        df = df.withColumn(f"{c}_rank", F.row_number().over(rank_order(group, f"{c}_n")))
        last = F.max(F.when(F.col(f"{c}_rank") == F.least(F.lit(k), F.col("_size")), F.col(f"{c}_n"))).over(w)
        df = df.withColumn("_size", F.count(F.lit(1)).over(w)).withColumn(f"{c}_margin", F.col(f"{c}_n") - last).drop("_size")
    head = columns[0]
    for c in columns[1:]:
        df = df.withColumn(f"{head}_minus_{c}", F.col(f"{head}_n") - F.col(f"{c}_n")).withColumn(f"{head}_{c}_ranks", F.col(f"{c}_rank") - F.col(f"{head}_rank"))
    return df


def linear_score(features: dict[str, Column], weights: dict[str, float], mean: dict[str, float] | None = None, scale: dict[str, float] | None = None, intercept: float = 0.0, clamp: bool = False) -> Column:
    """Standardised linear model: missing and non-finite features count 0, a zero scale counts 1."""
    total = F.lit(intercept)
    for name, w in weights.items():
        x = features[name]
        x = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
        total = total + w * (x - (mean or {}).get(name, 0.0)) / ((scale or {}).get(name, 1.0) or 1.0)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)) if clamp else total


def blend_grid(df: DataFrame, grid: list[dict[str, float]]) -> DataFrame:
    """One row per input row and blend: adds blend (its number) and score."""
    scores = F.posexplode(F.array(*[blend(g) for g in grid]))
    return df.select("*", scores.alias("blend", "score"))
