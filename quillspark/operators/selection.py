"""Selections of candidates for labelling: by rules in order, by boundaries and disagreement, and balanced splits of topics.

Candidates are (query_id, doc, ...); every step takes documents that no earlier one took.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.labels import generic_survey, short_abstract
from quillspark.functions.signals import holds_any
from quillspark.runtime import materialize

#: Words by which a paper looks like an application.
APPLICATION_TERMS = ["detection", "diagnosis", "forecasting", "enhancement", "tourism", "robot", "traffic", "medical"]


def bucket_selection(df: DataFrame, steps: list[tuple[str, Column, list[Column], int]], size: int | None = None) -> DataFrame:
    """(query_id, doc, bucket, place): steps (name, condition, order, number) one after the other, each taking the first rows of a
    query that fulfil its condition and are not taken yet, up to its number and to ``size`` in all. Places go on from step to
    step. A step keeps no more than its number of rows per query, so what is joined is small."""
    rows, out = materialize(df, "selection-candidates"), None
    for i, (name, condition, order, number) in enumerate(steps):
        free = rows.where(condition)
        if out is not None:
            free = free.join(out.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
        got = free.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_r") <= number).select("query_id", "doc", F.lit(name).alias("bucket"), F.lit(i).alias("step"), F.col("_r").alias("r"))
        out = materialize(got if out is None else out.unionByName(got), "selection")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("step", "r"))
    placed = out.withColumn("place", place)
    return (placed if size is None else placed.where(F.col("place") <= size)).select("query_id", "doc", "bucket", "place")


def boundary_candidates(df: DataFrame, ranks: list[str], priority: list[str], evaluated: list[str]) -> DataFrame:
    """(query_id, doc, reasons, focus, score): candidates with the reasons for which a label would help, what to look at, and a
    score: 100 for a topic that needs labels, 20 for one that is evaluated, 25 near the cut (best rank 8 to 35) or else 15
    for a rank up to 30, 20 where the methods' ranks differ by 20 or more, 10 each for applications and surveys, 5 for a
    short abstract, less a hundredth of the best rank. Rows have title, abstract and the rank columns."""
    some = F.array_compact(F.array(*[F.col(r) for r in ranks]))
    best = F.coalesce(F.array_min(some), F.lit(999_999))
    gap = F.when(F.size(some) >= 2, F.array_max(some) - F.array_min(some)).otherwise(0)
    text = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.substring(F.coalesce("abstract", F.lit("")), 1, 500)))
    applied, survey = holds_any(text, APPLICATION_TERMS), generic_survey(F.col("title"), F.col("abstract"))
    near = best.between(8, 35)
    rules = [
        ("topic_needs_more_labels", F.col("query_id").isin(priority), 100.0), ("validation_or_test_topic", F.col("query_id").isin(evaluated), 20.0), ("top10_top30_boundary_candidate", near, 25.0),
        ("high_rank_unjudged_candidate", ~near & (best <= 30), 15.0), ("ranker_disagreement_candidate", gap >= 20, 20.0), ("application_overpromotion_candidate", applied, 10.0),
        ("generic_survey_candidate", survey, 10.0), ("short_abstract_evidence_gap", short_abstract(F.col("abstract")), 5.0),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, n) for n, c, _ in rules]))
    score = sum((F.when(c, w).otherwise(0.0) for _, c, w in rules), F.lit(0.0)) - best * 0.01
    focus = F.when(survey, "generic_survey_check").when(applied, "application_overpromotion_check").when(gap >= 20, "hard_negative_check").when(near, "partial_match_check").otherwise("boundary_case_check")
    return df.select("query_id", "doc", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("boundary_case_candidate"))).alias("reasons"), focus.alias("focus"), score.alias("score"))


def audit_packet(errors: DataFrame, exclusions: dict[str, Column], priority: dict[str, int], most: int) -> tuple[DataFrame, DataFrame]:
    """(packet, excluded): rows (query_id, doc, reason, rank, seen) that no exclusion holds for, one per pair (the one seen last), by
    the smallest priority of its reason, then rank; and how many rows each first exclusion takes out."""
    first = F.coalesce(*[F.when(c, n) for n, c in exclusions.items()])
    marked = errors.withColumn("_out", first)
    weight = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col("reason")]
    kept = marked.where("_out is null").withColumn("_p", F.coalesce(weight, F.lit(1_000)))
    low = F.min("_p").over(Window.partitionBy("query_id", "doc"))
    last = F.row_number().over(Window.partitionBy("query_id", "doc").orderBy(F.desc("seen")))
    one = kept.withColumns({"_low": low, "_last": last}).where("_last = 1")
    best = one.orderBy("_low", "rank", "query_id", "doc").limit(most)  # a packet of a set size is the purpose
    return best.select("query_id", "doc", "reason", "rank"), marked.where("_out is not null").groupBy(F.col("_out").alias("excluded")).agg(F.count(F.lit(1)).alias("n"))


def anchors(df: DataFrame, category: Column, order: list[Column]) -> DataFrame:
    """(query_id, category, doc): the first document of each category; rows without a category are left out."""
    c = df.withColumn("category", category).where("category is not null")
    return c.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "category").orderBy(*order))).where("_r = 1").select("query_id", "category", "doc")


def patched(df: DataFrame, patch: DataFrame) -> DataFrame:
    """(query_id, place, doc, replaced): documents swapped by a list (query_id, old, new), places numbered anew; a document that is
    there already is not put in twice."""
    p = patch.select("query_id", F.col("old").alias("doc"), "new")
    out = df.join(p, ["query_id", "doc"], "left").select("query_id", "place", F.coalesce("new", "doc").alias("doc"), F.col("new").isNotNull().alias("replaced"))
    first = F.row_number().over(Window.partitionBy("query_id", "doc").orderBy("replaced", "place"))
    kept = out.withColumn("_r", first).where("_r = 1")
    return kept.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("place")).alias("place"), "doc", "replaced")


def evidence_selection(df: DataFrame, per_query: int, least: int, wider: int, few: int) -> DataFrame:
    """(query_id, doc, place, why): the first ``per_query`` rows if ``least`` of them have full text; otherwise, of a window of
    ``wider``, those without a vague abstract or with full text, the best by priority (full text, methods, best rank, place),
    in their first order; if these are under ``few``, the first of the window. Rows have place, full_text, vague, methods and
    best_rank."""
    w = Window.partitionBy("query_id")
    top = F.col("place") <= per_query
    d = df.withColumn("_enough", F.sum((top & F.col("full_text")).cast("int")).over(w) >= least)
    fit = F.col("full_text") | ~F.col("vague")
    score = F.when(F.col("full_text"), 100.0).otherwise(25.0) + F.least("methods", F.lit(5)) * 12.0 + F.greatest(25.0 - F.coalesce("best_rank", "place"), F.lit(0.0)) + F.greatest(21.0 - F.col("place"), F.lit(0.0))
    wide = d.where(~F.col("_enough") & (F.col("place") <= max(wider, per_query)) & fit).withColumn("_s", score)
    n = F.count(F.lit(1)).over(w)
    by_score, by_place = F.row_number().over(w.orderBy(F.desc("_s"), "place")), F.row_number().over(w.orderBy("place"))
    wide = wide.withColumns({"_n": F.least(n, F.lit(per_query)), "_a": by_score, "_b": by_place}).where(F.when(F.col("_n") < few, F.col("_b")).otherwise(F.col("_a")) <= per_query)
    plain = d.where(F.col("_enough") & top).select("query_id", "doc", "place", F.lit("enough full text").alias("why"))
    return plain.unionByName(wide.select("query_id", "doc", "place", F.lit("widened").alias("why")))


def active_learning(df: DataFrame, weights: dict[str, float], n: int) -> DataFrame:
    """(query_id, doc, score, place): the n candidates of each query with the largest weighted sum of signals, nulls 0."""
    score = sum((w * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    s = df.select("query_id", "doc", F.round(score, 9).alias("score"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))).where(F.col("place") <= n)


def balanced_sides(topics: DataFrame, size: int, target: int) -> tuple[list[str], list[str]]:
    """Topics of val and test: of all choices of ``size`` val and ``size`` test topics the one whose hard negatives come
    nearest to ``target`` in both and to each other (1.5 times), with 100,000 for a side that lacks a relevance bucket or hard
    negatives; ties go to the first in order. Both are empty if there are fewer topics. ``topics`` has (query_id, negatives, b0,
    b1, b2), one row each.

    The penalty of a side sees only the negatives of its topics and which buckets they have. Of topics alike in these, one past
    the first 2 * ``size`` gives way to an earlier one that is free, at the same score, so the best choice never has it: the
    driver gathers the first 2 * ``size`` of each kind, and no choice is lost. Sides of equal penalty and negatives make a class;
    classes are paired, and their sides listed, in order, as far as a pair needs them."""
    buckets = ["b0", "b1", "b2"]
    place = F.row_number().over(Window.partitionBy("negatives", *[F.col(b) > 0 for b in buckets]).orderBy("query_id"))
    rows = topics.withColumn("_r", place).where(F.col("_r") <= 2 * size).orderBy("query_id").collect()
    if len(rows) < 2 * size:
        return [], []
    negatives, flags = [r["negatives"] for r in rows], [sum((r[b] > 0) << i for i, b in enumerate(buckets)) for r in rows]
    places: dict[int, list[int]] = {}
    for i, n in enumerate(negatives):
        places.setdefault(n, []).append(i)
    kinds, sums = {*zip(negatives, flags)}, {(0, 0)}
    for _ in range(size):
        sums = {(n + m, f | g) for n, f in sums for m, g in kinds}

    def penalty(n: int, f: int) -> float:
        return abs(n - target) + 100_000.0 * ((f != 7) + (n == 0))

    def listed(p: float, n: int) -> Iterator[tuple[int, ...]]:
        for head in itertools.combinations(range(len(rows)), size - 1):
            f = reduce(or_, (flags[i] for i in head), 0)
            for i in places.get(n - sum(negatives[j] for j in head), ()):
                if (not head or i > head[-1]) and penalty(n, f | flags[i]) == p:
                    yield *head, i

    kept: dict[tuple[float, int], tuple[list, Iterator]] = {}

    def sides(p: float, n: int) -> Iterator[tuple[int, ...]]:
        seen, more = kept.setdefault((p, n), ([], listed(p, n)))
        for i in itertools.count():
            if i == len(seen):
                if (side := next(more, None)) is None:
                    return
                seen.append(side)
            yield seen[i]

    classes = sorted({(penalty(n, f), n) for n, f in sums})
    best = None
    for p, n in classes:
        if best is not None and p + classes[0][0] > best[0]:
            break  # no later class can do better
        for q, m in classes:
            if best is not None and p + q > best[0]:
                break
            score = p + q + 1.5 * abs(n - m)
            if best is not None and score > best[0]:
                continue
            pair = next(((val, test) for val in sides(p, n) for test in sides(q, m) if not {*val} & {*test}), None)
            if pair and (best is None or (score, *pair) < best):
                best = (score, *pair)
    return tuple([rows[i]["query_id"] for i in side] for side in best[1:])


def balanced_splits(topics: DataFrame, size: int, target: int) -> dict[str, list[str]]:
    """Topics of train, val and test by :func:`balanced_sides`, all of them gathered by the driver."""
    val, test = balanced_sides(topics, size, target)
    names = [r["query_id"] for r in topics.select("query_id").orderBy("query_id").collect()]
    return {"train": [t for t in names if t not in {*val, *test}], "val": val, "test": test}
