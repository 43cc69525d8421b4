"""Coverage metrics, and what changes between two rankings of the same labelled candidates.

Ranked rows are (method, query_id, doc, score, rank) with the label fields reading, topic, bucket, negative, role, second_role
and status; gain is null where a document is not judged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.labels import hidden_positive

#: Roles that coverage counts, the four of a reading path first, and penalties of copies.
COVERED_ROLES = ["background", "foundational", "core_methods", "recent_frontier", "evaluation_benchmark", "application"]
PATH_ROLES = COVERED_ROLES[:4]
DUPLICATE_PENALTIES = {"none": 0.0, "uncertain": 0.25, "near_duplicate": 0.5, "exact_duplicate": 1.0}
#: Rank of a document that a ranking does not have.
ABSENT = 99


def _roles(names: list[str], flag: Column) -> Column:
    own = F.array_intersect(F.array("role", "second_role"), F.array(*[F.lit(n) for n in names]))
    return F.when(flag, own).otherwise(F.array().cast("array<string>"))


def _distinct(lists: Column) -> Column:
    return F.array_distinct(F.flatten(F.collect_set(lists)))  # no more elements than there are roles


def coverage(rows: DataFrame, k: int = 10) -> DataFrame:
    """(method, query_id, duplicate_penalty, duplicate_mean, role_coverage, path_coverage) of the top k: penalties over k and over
    what there is; roles of documents worth 0.3 or more, of those that the query's labels have (or of all six); path roles
    of documents worth 0.5 or more, of four."""
    top = F.col("rank") <= k
    penalty = reduce(lambda acc, kv: acc.when(F.col("status") == kv[0], kv[1]), DUPLICATE_PENALTIES.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    by = rows.groupBy("method", "query_id").agg(
        F.sum(F.when(top, penalty).otherwise(0.0)).alias("p"), F.sum(top.cast("int")).alias("n"), _distinct(_roles(COVERED_ROLES, F.col("reading") >= 0.3)).alias("there"),
        _distinct(_roles(COVERED_ROLES, top & (F.col("reading") >= 0.3))).alias("got"), _distinct(_roles(PATH_ROLES, top & (F.col("reading") >= 0.5))).alias("path"),
    )
    of = F.when(F.size("there") > 0, F.size("there")).otherwise(len(COVERED_ROLES))
    return by.select("method", "query_id", (F.col("p") / k).alias("duplicate_penalty"), (F.col("p") / F.greatest("n", F.lit(1))).alias("duplicate_mean"), (F.size(F.array_intersect("got", "there")) / of).alias("role_coverage"), (F.size("path") / len(PATH_ROLES)).alias("path_coverage"))


def gain_ndcg(rows: DataFrame, gains: list[str], k: int = 10) -> DataFrame:
    """(method, query_id, field, ndcg): linear NDCG with the ideal over all labels, for any number of gain columns at once."""
    long = rows.select("method", "query_id", "doc", "rank", F.inline(F.array(*[F.struct(F.lit(g).alias("field"), F.coalesce(F.col(g).cast("double"), F.lit(0.0)).alias("g")) for g in gains])))
    best = F.row_number().over(Window.partitionBy("method", "query_id", "field").orderBy(F.desc("g"), "doc"))
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col("g") / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    by = long.withColumn("best", best).groupBy("method", "query_id", "field").agg(part("rank").alias("got"), part("best").alias("ideal"))
    return by.select("method", "query_id", "field", F.when(F.col("ideal") > 0, F.col("got") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def path_metrics(rows: DataFrame, relevant: Column) -> DataFrame:
    """(method, queries, precision_at_5, recall_at_10) over the queries that have a relevant label."""
    rel = relevant.cast("int")
    by = rows.groupBy("method", "query_id").agg(F.sum(rel).alias("all"), F.sum(F.when(F.col("rank") <= 5, rel).otherwise(0)).alias("r5"), F.sum((F.col("rank") <= 5).cast("int")).alias("n5"), F.sum(F.when(F.col("rank") <= 10, rel).otherwise(0)).alias("r10"))
    return by.where(F.col("all") > 0).groupBy("method").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("r5") / F.greatest("n5", F.lit(1))).alias("precision_at_5"), F.avg(F.col("r10") / F.col("all")).alias("recall_at_10"))


def pool_metrics(rows: DataFrame, k: int = 10) -> DataFrame:
    """(method, query_id, pool, judged_in_pool, label_coverage, judged_at_k, unjudged_at_k, all_rankable): how much of a candidate
    pool is labelled, and whether every candidate has a score."""
    judged, top = F.col("gain").isNotNull(), F.col("rank") <= k
    return rows.groupBy("method", "query_id").agg(
        F.count(F.lit(1)).alias("pool"), F.sum(judged.cast("int")).alias("judged_in_pool"), F.avg(judged.cast("double")).alias("label_coverage"),
        F.sum((judged & top).cast("int")).alias("judged_at_k"), F.sum((~judged & top).cast("int")).alias("unjudged_at_k"), F.min(F.col("score").isNotNull()).alias("all_rankable"),
    )


def reveal_deltas(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(method, query_id, metric, before, after, delta): the same metrics of the same runs under two label sets."""
    long = lambda df, name: df.select("method", "query_id", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in columns])))
    return long(before, "before").join(long(after, "after"), ["method", "query_id", "metric"]).withColumn("delta", F.col("after") - F.col("before"))


def suppression(rows: DataFrame, k: int = 10) -> DataFrame:
    """(method, candidates, promoted, accuracy): hard negatives among the candidates and in the top k, and the share kept out."""
    by = rows.where("negative").groupBy("method").agg(F.count(F.lit(1)).alias("candidates"), F.sum((F.col("rank") <= k).cast("int")).alias("promoted"))
    return by.withColumn("accuracy", 1.0 - F.col("promoted") / F.col("candidates"))


def _two(rows: DataFrame, base: str, other: str) -> DataFrame:
    """One row per pair with the ranks of two methods; a method that lacks the document has ABSENT."""
    rank = lambda m: F.coalesce(F.max(F.when(F.col("method") == m, F.col("rank"))), F.lit(ABSENT))
    keep = [c for c in ("gain", "reading", "topic", "bucket", "negative", "role") if c in rows.columns]
    return rows.where(F.col("method").isin(base, other)).groupBy("query_id", "doc").agg(rank(base).alias("base_rank"), rank(other).alias("rank"), *[F.max(c).alias(c) for c in keep])


def swap_sensitivity(rows: DataFrame, ndcg: DataFrame, base: str, other: str, k: int = 10) -> DataFrame:
    """(query_id, swaps, few, <field>_delta ...): documents that only the other method has in its top k, whether they are one or
    two, and the change of every field of :func:`gain_ndcg`."""
    swaps = _two(rows, base, other).groupBy("query_id").agg(F.sum(((F.col("rank") <= k) & (F.col("base_rank") > k)).cast("int")).alias("swaps"))
    value = lambda m: F.max(F.when(F.col("method") == m, F.col("ndcg")))
    d = ndcg.groupBy("query_id", "field").agg((value(other) - value(base)).alias("delta"))
    fields = [r[0] for r in ndcg.select("field").distinct().orderBy("field").collect()]  # the names given to gain_ndcg
    wide = d.groupBy("query_id").agg(*[F.max(F.when(F.col("field") == f, F.col("delta"))).alias(f"{f}_delta") for f in fields])
    return swaps.join(wide, "query_id").withColumn("few", F.col("swaps") <= 2)


def promotion_bias(rows: DataFrame, flags: DataFrame, base: str, other: str, k: int = 10) -> DataFrame:
    """(side, shown, short_rate, survey_rate, mean_words): flags (doc, words, survey) of what each of two methods shows. Rates are
    over k places of every query, filled or not."""
    queries = rows.agg(F.greatest(F.countDistinct("query_id") * k, F.lit(1)).alias("places"))
    top = rows.where((F.col("rank") <= k) & F.col("method").isin(base, other)).join(flags, "doc", "left")
    by = top.groupBy("method").agg(F.count(F.lit(1)).alias("shown"), F.sum((F.coalesce("words", F.lit(0)) < 50).cast("int")).alias("s"), F.sum(F.coalesce("survey", F.lit(False)).cast("int")).alias("g"), F.avg(F.coalesce("words", F.lit(0))).alias("mean_words"))
    return by.crossJoin(F.broadcast(queries)).select("method", "shown", (F.col("s") / F.col("places")).alias("short_rate"), (F.col("g") / F.col("places")).alias("survey_rate"), "mean_words")


def changes(rows: DataFrame, base: str, other: str, k: int = 10) -> DataFrame:
    """(query_id, promoted, demoted): for every query the documents that enter and leave the top k, as arrays of (doc, ranks,
    label) in rank order. Each array has at most k entries."""
    t = _two(rows, base, other)
    entry = F.struct("rank", "base_rank", "doc", "reading", "bucket", "negative")
    left = F.struct(F.col("base_rank").alias("was"), F.col("rank"), "doc", "reading", "bucket", "negative")
    new, old = (F.col("rank") <= k) & (F.col("base_rank") > k), (F.col("base_rank") <= k) & (F.col("rank") > k)
    return t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(new, entry))).alias("promoted"), F.array_sort(F.collect_list(F.when(old, left))).alias("demoted"))


def causes(rows: DataFrame, base: str, other: str, survey: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, causes): why a ranking may have changed, by rules over its promoted and demoted documents; none of them
    gives score_boundary_instability. ``survey`` is (doc, survey); scores are those of the two methods."""
    score = lambda m: F.max(F.when(F.col("method") == m, F.col("score")))
    s = rows.where(F.col("method").isin(base, other)).groupBy("query_id", "doc").agg(score(base).alias("base_score"), score(other).alias("other_score"))
    t = _two(rows, base, other).join(s, ["query_id", "doc"]).join(survey, "doc", "left")
    up, down = (F.col("rank") <= k) & (F.col("base_rank") > k), (F.col("base_rank") <= k) & (F.col("rank") > k)
    rules = {
        "application_or_generic_paper_promoted": up & (F.coalesce("survey", F.lit(False)) | (F.col("role") == "application")),
        "foundational_good_paper_demoted": down & (F.col("bucket") == 2) & (F.col("reading") >= 0.8),
        "hard_negative_promoted": up & F.col("negative"),
        "high_score_for_topic_mismatch": up & (F.col("other_score") > F.col("base_score")) & (F.col("topic") < 0.6),
        "label_boundary_uncertainty": (up | down) & F.col("reading").between(0.45, 0.75),
        "other_overrides_base_too_much": up & (F.col("other_score") - F.col("base_score") > 0.05),
        "base_was_confident": F.col("base_score") >= 0.85,
    }
    by = t.groupBy("query_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    found = F.array_compact(F.array(*[F.when(F.col(n), n) for n in rules]))
    return by.select("query_id", F.when(F.size(found) > 0, F.array_sort(found)).otherwise(F.array(F.lit("score_boundary_instability"))).alias("causes"))


def parity(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row: rows that both have, rows of one side only, the largest difference of their scores, scores that are no numbers,
    and whether the two agree."""
    l, r = left.select(*keys, F.col("score").alias("l"), F.lit(1).alias("_l")), right.select(*keys, F.col("score").alias("r"), F.lit(1).alias("_r"))
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    one = l.join(r, keys, "full").agg(F.sum(both.cast("int")).alias("rows"), F.sum((~both).cast("int")).alias("alone"), F.coalesce(F.max(F.when(both, F.abs(F.col("l") - F.col("r")))), F.lit(0.0)).alias("largest"), F.sum((both & (odd("l") | odd("r"))).cast("int")).alias("odd"))
    return one.withColumn("agree", (F.col("alone") == 0) & (F.col("odd") == 0) & (F.col("largest") <= tolerance))


def sanity(results: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, shown, no_overlap, repeated_titles): results whose text shares no word with the query, and results with the
    title of another one of the query. ``docs`` has doc, title (normalised) and words (array); results have query_words."""
    top = results.where(F.col("rank") <= k).join(docs, "doc")
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", "title"))
    same = (F.coalesce("title", F.lit("")) != "") & (n > 1)
    return top.withColumn("same", same).groupBy("query_id").agg(F.count(F.lit(1)).alias("shown"), F.sum((~F.arrays_overlap("query_words", "words")).cast("int")).alias("no_overlap"), F.sum(F.col("same").cast("int")).alias("repeated_titles"))


def blend_effects(rows: DataFrame, base: str, other: str, k: int = 10) -> DataFrame:
    """One row: hard negatives that fall or leave the top k, hidden positives that do, and hard negatives still there."""
    cut = lambda c: F.when(F.col(c) <= k, F.col(c)).otherwise(ABSENT)
    t = _two(rows, base, other).withColumns({"base_rank": cut("base_rank"), "rank": cut("rank")})
    worse = (F.col("base_rank") < ABSENT) & (F.col("rank") > F.col("base_rank"))
    good = hidden_positive(F.col("reading"), F.col("topic"))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    return t.agg(count(F.col("negative") & worse).alias("fixed"), count(good & worse).alias("harmed"), count(F.col("negative") & (F.col("rank") < ABSENT)).alias("still_promoted"), F.avg(F.when(F.col("negative"), F.col("rank") - F.col("base_rank"))).alias("mean_move"))


def hidden_harm(rows: DataFrame, base: str, flagged: Column) -> DataFrame:
    """(method, harmed, improved, unchanged, mean_delta, dropped): flagged documents against their rank under the base method."""
    b = rows.where((F.col("method") == base) & flagged).select("query_id", "doc", F.col("rank").alias("base_rank"))
    d = rows.where(F.col("method") != base).join(b, ["query_id", "doc"]).withColumn("d", F.col("rank") - F.col("base_rank"))
    n = lambda c: F.sum(c.cast("int"))
    return d.groupBy("method").agg(n(F.col("d") > 0).alias("harmed"), n(F.col("d") < 0).alias("improved"), n(F.col("d") == 0).alias("unchanged"), F.avg("d").alias("mean_delta"), n((F.col("base_rank") <= 10) & (F.col("rank") > 10)).alias("dropped"))


def failures(ndcg: DataFrame, pool: DataFrame, method: str, reading_base: str, topic_base: str, gap: float = 0.15, most_unjudged: int = 5) -> DataFrame:
    """(query_id, kind, value, against): where a method loses in reading against one method or in topic against another, stays far
    below the best of all methods, or shows many unjudged documents."""
    value = lambda m, f: F.max(F.when((F.col("method") == m) & (F.col("field") == f), F.col("ndcg")))
    best = F.max(F.when(F.col("field") == "reading", F.col("ndcg")))
    w = ndcg.groupBy("query_id").agg(value(method, "reading").alias("r"), value(reading_base, "reading").alias("rb"), value(method, "topic").alias("t"), value(topic_base, "topic").alias("tb"), best.alias("o"))
    w = w.join(pool.where(F.col("method") == method).select("query_id", "unjudged_at_k"), "query_id", "left")
    case = lambda cond, kind, v, against: F.when(cond, F.struct(F.lit(kind).alias("kind"), v.cast("double").alias("value"), against.cast("double").alias("against")))
    kinds = F.array_compact(F.array(
        case(F.col("r") < F.col("rb"), "loses_reading", F.col("r"), F.col("rb")), case(F.col("t") < F.col("tb"), "loses_topic", F.col("t"), F.col("tb")),
        case(F.col("o") - F.col("r") >= gap, "far_from_best", F.col("r"), F.col("o")), case(F.col("unjudged_at_k") >= most_unjudged, "many_unjudged", F.col("unjudged_at_k"), F.lit(most_unjudged)),
    ))
    return w.select("query_id", F.inline(kinds))


def score_coverage(scores: DataFrame, methods: list[str]) -> DataFrame:
    """(method, available, total, share, comparable): scores that are there, and rows for which every method has one."""
    whole = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in methods])
    one = scores.agg(F.count(F.lit(1)).alias("total"), F.sum(whole.cast("int")).alias("comparable"), *[F.count(m).alias(m) for m in methods])
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("available"), F.col("total"), (F.col(m) / F.col("total")).alias("share"), F.col("comparable")) for m in methods])))


def behaviour(rows: DataFrame, delta: DataFrame, k: int = 10) -> DataFrame:
    """(method, negatives_shown, applications_shown, late_positives, better, worse): hard negatives and applications in the top k,
    queries whose first strong positive comes after it, and queries that gain over 0.02 or lose 0.05 or more."""
    top = F.col("rank") <= k
    q = rows.groupBy("method", "query_id").agg(F.sum((top & F.col("negative")).cast("int")).alias("n"), F.sum((top & (F.col("role") == "application")).cast("int")).alias("a"), F.min(F.when(F.col("bucket") == 2, F.col("rank"))).alias("first"))
    by = q.groupBy("method").agg(F.sum("n").alias("negatives_shown"), F.sum("a").alias("applications_shown"), F.sum((F.coalesce("first", F.lit(0)) > k).cast("int")).alias("late_positives"))
    d = delta.groupBy("method").agg(F.sum((F.col("delta") > 0.02).cast("int")).alias("better"), F.sum((F.col("delta") <= -0.05).cast("int")).alias("worse"))
    return by.join(d, "method", "left").select("method", "negatives_shown", "applications_shown", "late_positives", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("better", "worse")])


def choose_probe(probes: DataFrame) -> DataFrame:
    """The probe to go on with, from (method, reading_delta, severe, negative_delta): of those without severe losses and with no
    more hard negatives the one with the largest gain; if there is none, the largest gain of all. Ties go to fewer severe
    losses, then to the smaller name."""
    safe = F.coalesce((F.col("severe") == 0) & (F.col("negative_delta") <= 0), F.lit(False))
    order = F.struct((~safe).alias("s"), (-F.col("reading_delta")).alias("d"), "severe", "method")
    return probes.where("reading_delta is not null").groupBy().agg(F.min_by(F.struct("method", "reading_delta", "severe", safe.alias("safe")), order).alias("x")).where("x is not null").select("x.*")


def winners(metrics: DataFrame, column: str, group: str) -> DataFrame:
    """(group, method, value): the method with the largest mean of a metric in each group, ties to the smaller name."""
    m = metrics.groupBy(group, "method").agg(F.avg(column).alias("v"))
    return m.groupBy(group).agg(F.min_by(F.struct("method", F.col("v").alias("value")), F.struct((-F.round("v", 9)).alias("v"), "method")).alias("x")).select(group, "x.*")


def disagreements(rows: DataFrame, base: str, other: str, most: int = 25) -> DataFrame:
    """(kind, place, query_id, doc, base_rank, rank): documents that two methods rank differently: good ones that fall by more than
    four places, hard negatives that leave the top 10, and all that enter or leave it; the first of each kind by reading and
    rank difference."""
    t = _two(rows, base, other)
    in_b, in_o = F.col("base_rank") <= 10, F.col("rank") <= 10
    kinds = F.array_compact(F.array(
        F.when((F.col("reading") >= 0.75) & in_b & (F.col("rank") > F.col("base_rank") + 4), "good_falls"), F.when(F.col("negative") & in_b & ~in_o, "negative_leaves"),
        F.when(in_o & ~in_b, "enters"), F.when(in_b & ~in_o, "leaves"),
    ))
    k = t.withColumn("kind", F.explode(kinds))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("reading"), F.desc(F.col("rank") - F.col("base_rank")), "query_id", "doc"))
    return k.withColumn("place", place).where(F.col("place") <= most).select("kind", "place", "query_id", "doc", "base_rank", "rank")


def instability(overlap: DataFrame, gaps: DataFrame, swaps: DataFrame) -> DataFrame:
    """(query_id, jaccard, gap, swaps, unstable): overlap of two top lists, the gap at the cut, and the swaps between them; unstable
    are small gaps with a changed list."""
    j = overlap.select("query_id", "jaccard").join(gaps, "query_id", "left").join(swaps.select("query_id", "swaps"), "query_id", "left")
    return j.withColumn("unstable", F.coalesce((F.col("gap") < 0.05) & (F.col("jaccard") < 1.0), F.lit(False)))


def top_export(rows: DataFrame, weights: dict[str, float], method: str, k: int = 10) -> DataFrame:
    """(query_id, rank, doc, bucket, largest, share): the shown documents of a method, with the score component that counts most
    (value times weight, by size) and its share of all."""
    parts = F.array(*[F.struct(F.abs(F.col(c) * w).alias("size"), F.lit(c).alias("name")) for c, w in weights.items()])
    total = reduce(lambda a, b: a + b, [F.abs(F.col(c) * w) for c, w in weights.items()])
    top = rows.where((F.col("method") == method) & (F.col("rank") <= k)).withColumn("x", F.array_max(parts))
    return top.select("query_id", "rank", "doc", "bucket", F.col("x.name").alias("largest"), F.when(total > 0, F.col("x.size") / total).otherwise(0.0).alias("share"))
