"""Queries of coverage metrics, label reports and comparisons of rankings over labelled pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import labels as L
from quillspark.functions.text import lexical_tokens, normal_title, word_tokens
from quillspark.operators import diagnostics as D
from quillspark.operators import evaluation as E
from quillspark.operators import fusion as X
from quillspark.operators import labelsets as S
from quillspark.operators import ranking as N
from quillspark.operators.queries_evaluation import _metric_sql, _n
from quillspark.operators.queries_labels import _A, _T, LAB, labelled, labelled_runs
from quillspark.operators.queries_retrieval import BASE, documents, query_table, sql_hits, sql_top
from quillspark.operators.retrieval import bm25_top
from quillspark.runtime import load

BASE_M, OTHER_M = "cited", "recent"
GAINS = ["reading", "topic", "beginner", "intermediate", "advanced"]


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "papers").select(F.col("id").alias("doc"), F.size(word_tokens(F.coalesce("abstract", F.lit("")))).alias("words"), L.generic_survey(F.col("title"), F.col("abstract")).alias("survey"))


def coverage_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.coverage(labelled_runs(spark, d)), "duplicate_penalty", "duplicate_mean", "role_coverage", "path_coverage")


def gain_quality(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.gain_ndcg(labelled_runs(spark, d), GAINS).groupBy("method", "field").agg(F.count(F.lit(1)).alias("queries"), F.avg("ndcg").alias("ndcg")), "ndcg")


def path_quality(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.path_metrics(labelled_runs(spark, d), F.col("bucket") == 2), "precision_at_5", "recall_at_10")


def pool_quality(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.pool_metrics(labelled_runs(spark, d)), "label_coverage")


def revealed_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics when only the labels of even documents are known, and when all are."""
    runs = labelled_runs(spark, d).select("method", "query_id", "doc", "score", "gain", "negative")
    few = runs.withColumn("gain", F.when(F.col("doc") % 2 == 0, F.col("gain")))
    return _r(D.reveal_deltas(E.per_query(few, 10), E.per_query(runs, 10), ["ndcg_linear", "recall"]), "before", "after", "delta")


def revealed_labels(spark: SparkSession, d: str) -> DataFrame:
    """How the newly known labels fall into buckets, over all and over those in a top 10."""
    r = labelled_runs(spark, d).where("method = 'cited' and doc % 2 = 1").withColumn("place", F.when(F.col("rank") <= 10, "top").otherwise("below"))
    return S.distribution(r, None, ["bucket", "negative"]).unionByName(S.distribution(r, "place", ["bucket", "negative"]))


def negative_suppression(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.suppression(labelled_runs(spark, d)), "accuracy")


def swap_effects(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_runs(spark, d)
    return _r(D.swap_sensitivity(rows, D.gain_ndcg(rows, ["reading", "topic"]), BASE_M, OTHER_M), "reading_delta", "topic_delta")


def promoted_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.promotion_bias(labelled_runs(spark, d), _flags(spark, d), BASE_M, OTHER_M), "short_rate", "survey_rate", "mean_words")


def list_changes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that enter and leave the top 5, in order."""
    c = D.changes(labelled_runs(spark, d), BASE_M, OTHER_M, 5)
    names = lambda col: F.array_join(F.transform(col, lambda x: x["doc"].cast("string")), ",").alias(col)
    return c.select("query_id", names("promoted"), names("demoted"))


def change_causes(spark: SparkSession, d: str) -> DataFrame:
    s = X.scaled(labelled(spark, d), "query_id", ["cited", "recent"])
    both = s.select("*", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.round(f"{m}_n", 9).alias("score")) for m in (BASE_M, OTHER_M)])))
    c = D.causes(N.ranked(both.withColumn("g", F.concat_ws("|", "method", "query_id")), "g"), BASE_M, OTHER_M, _flags(spark, d).select("doc", "survey"), 5)
    return c.select("query_id", F.array_join("causes", ",").alias("causes"))


def score_parity(spark: SparkSession, d: str) -> DataFrame:
    """A blend computed per row and by a grid must agree."""
    s = X.scaled(labelled(spark, d), "query_id", ["cited", "recent"])
    one = s.select("query_id", "doc", (0.6 * F.col("cited_n") + 0.4 * F.col("recent_n")).alias("score"))
    two = X.blend_grid(s, [{"cited_n": 0.6, "recent_n": 0.4}]).select("query_id", "doc", "score")
    return _r(D.parity(one, two, ["query_id", "doc"]), "largest")


def retrieval_sanity(spark: SparkSession, d: str) -> DataFrame:
    docs, q = documents(spark, d), query_table(spark, d)
    runs = N.ranked(bm25_top(docs.select("doc", "text"), q, 10), "query_id").join(q.select("query_id", lexical_tokens(F.col("query")).alias("query_words")), "query_id")
    return D.sanity(runs, docs.select("doc", normal_title(F.col("title")).alias("title"), lexical_tokens(F.coalesce("title", F.lit(""))).alias("words")))


def blend_effects(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.blend_effects(labelled_runs(spark, d), BASE_M, OTHER_M), "mean_move")


def hidden_harm(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.hidden_harm(labelled_runs(spark, d), BASE_M, L.hidden_positive(F.col("reading"), F.col("topic"))), "mean_delta")


def failure_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_runs(spark, d)
    ndcg = D.gain_ndcg(rows, ["reading", "topic"]).withColumn("ndcg", F.round("ndcg", 9))
    return _r(D.failures(ndcg, D.pool_metrics(rows), "recent", "cited", "long"), "value", "against")


def score_availability(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "papers")
    return _r(D.score_coverage(p, ["year", "citation_count", "abstract_word_count"]), "share")


def method_behaviour(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_runs(spark, d)
    m = D.gain_ndcg(rows, ["reading"]).select("method", "query_id", F.round("ndcg", 9).alias("ndcg"))
    return D.behaviour(rows, E.deltas(m, "ndcg", BASE_M))


def chosen_probe(spark: SparkSession, d: str) -> DataFrame:
    m = E.per_query(labelled_runs(spark, d).select("method", "query_id", "doc", "score", "gain", "negative"), 10)
    delta, neg = E.deltas(m, "ndcg_linear", BASE_M), E.deltas(m, "negative_share", BASE_M)
    probes = delta.groupBy("method").agg(F.round(F.avg("delta"), 9).alias("reading_delta"), F.sum((F.round("delta", 9) <= -0.05).cast("int")).alias("severe"))
    return _r(D.choose_probe(probes.join(neg.groupBy("method").agg(F.round(F.avg("delta"), 9).alias("negative_delta")), "method")), "reading_delta")


def intent_winners(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.winners(D.gain_ndcg(labelled_runs(spark, d), GAINS), "ndcg", "field"), "value")


def rank_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return D.disagreements(labelled_runs(spark, d), BASE_M, OTHER_M)


def ranking_instability(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_runs(spark, d)
    over = E.top_overlap(rows.select("method", "query_id", "doc", "score"), BASE_M, OTHER_M, 5)
    gaps = N.gap_at(rows.where("method = 'cited'").select("query_id", "doc", "score"), "query_id", 5)
    swaps = D.swap_sensitivity(rows, D.gain_ndcg(rows, ["reading"]), BASE_M, OTHER_M, 5)
    return _r(D.instability(over, gaps, swaps), "jaccard", "gap")


def shown_components(spark: SparkSession, d: str) -> DataFrame:
    s = X.scaled(labelled_runs(spark, d), "query_id", ["cited", "recent", "long"])
    return _r(D.top_export(s, {"cited_n": 0.5, "recent_n": 0.3, "long_n": 0.2}, "cited", 5), "share")


def topic_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _r(S.topic_profile(labelled(spark, d)), "reading", "topic", "negative_share")


def label_distributions(spark: SparkSession, d: str) -> DataFrame:
    return S.distribution(labelled(spark, d), "query_id", ["bucket", "role", "status"])


def label_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    return S.sufficiency(labelled(spark, d), ["query_id", "role"], 8, 2)


def label_progress(spark: SparkSession, d: str) -> DataFrame:
    j = labelled(spark, d)
    return _r(S.progress(j, j.where("gain is not null"), "query_id"), "share")


def unjudged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Lexical candidates of every query that no label knows."""
    best = bm25_top(documents(spark, d).select("doc", "text"), query_table(spark, d), 10).withColumn("query_id", F.lower(F.trim("query_id")))
    return S.unjudged(best.select("query_id", "doc"), labelled(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("unjudged"))


def topic_priorities(spark: SparkSession, d: str) -> DataFrame:
    m = D.gain_ndcg(labelled_runs(spark, d), ["reading"])
    losses = E.deltas(m, "ndcg", BASE_M).where(F.round("delta", 9) < 0).select("query_id", F.col("delta").alias("loss"))
    return _r(S.topic_priority(losses, ["mq-0001", "mq-0002"]), "priority")


def repeated_titles(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "papers").select(F.coalesce("venue", F.lit("")).alias("query_id"), F.col("id").alias("doc"), "title")
    return S.repeated_titles(p, normal_title(F.col("title"))).where("repeated").select("query_id", "doc")


def label_sets(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that are positives, negatives or both, counted."""
    j = labelled(spark, d)
    return S.set_comparison(j.where("gain is not null"), j.where("negative"), S.KEY).groupBy("side").agg(F.count(F.lit(1)).alias("pairs"))


def joined_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of two models and labels by exact key; keys that one of them lacks are listed, not dropped."""
    j = labelled(spark, d)
    rows, missing = S.exact_join({"labels": j.where("gain is not null").select(*S.KEY, "gain"), "first": j.where("doc % 5 <> 0").select(*S.KEY, "cited"), "second": j.where("doc % 7 <> 0").select(*S.KEY, "long")}, S.KEY)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("joined").alias("what"), "n").unionByName(missing.groupBy(F.col("lacks").alias("what")).agg(F.count(F.lit(1)).alias("n")))


def label_problems(spark: SparkSession, d: str) -> DataFrame:
    """Errors and warnings of labels, labels known from another set, and candidates without one."""
    j = labelled(spark, d)
    hard = {"reading": F.col("reading").between(0, 1), "topic": F.col("topic").between(0, 1), "positive_negative": ~((F.col("reading") >= 0.5) & F.col("negative"))}
    soft = {"role": F.col("role") != F.col("second_role"), "topic_of_negative": ~(F.col("negative") & (F.col("topic") >= 0.5)), "level": F.greatest("beginner", "intermediate", "advanced") > 0}
    found = S.label_checks(j.where("gain is not null"), hard, soft, j.where("doc % 9 = 0"), j.where("doc % 4 = 0"))
    return found.groupBy("level", "rule").agg(F.count(F.lit(1)).alias("n"))


def override_preflight(spark: SparkSession, d: str) -> DataFrame:
    """Overriding keys that no candidate has; none may be used then."""
    j = labelled(spark, d)
    return S.outside(j.where("doc % 3 = 0"), j.where("gain is not null"), S.KEY)


def label_versions(spark: SparkSession, d: str) -> DataFrame:
    """Labels of two versions with different column names, in common columns."""
    j = labelled(spark, d)
    defaults = {"reading_value": "0.0D", "topic_match": "cast(null as double)", "hard": "false"}
    old = S.common_label(j.where("doc % 2 = 0"), {"reading_value": "reading", "hard": "negative"}, defaults, "v1")
    new = S.common_label(j.where("doc % 2 = 1"), {"reading_value": "gain", "topic_match": "topic"}, defaults, "v2")
    return old.unionByName(new).groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.count("topic_match").alias("topics"), F.round(F.sum("reading_value"), 6).alias("reading"), F.sum(F.col("hard").cast("int")).alias("hard"))


def example_splits(spark: SparkSession, d: str) -> DataFrame:
    """Counts and distinct papers of every stored split, overlap of methods and what they lack."""
    t = load(spark, d, "training_examples").select(F.lower(F.trim("split")).alias("split"), "label_source", "positive_paper_id", F.size("negative_paper_ids").alias("k"))
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("positive_paper_id").alias("papers"), F.countDistinct("label_source").alias("sources"), F.round(F.avg(F.when(F.col("k") >= 0, F.col("k"))), 6).alias("negatives"))


QUERIES = {
    f.__name__: f
    for f in (
        coverage_metrics, gain_quality, path_quality, pool_quality, revealed_metrics, revealed_labels, negative_suppression, swap_effects, promoted_kinds, list_changes, change_causes, score_parity, retrieval_sanity,
        blend_effects, hidden_harm, failure_cases, score_availability, method_behaviour, chosen_probe, intent_winners, rank_disagreements, ranking_instability, shown_components, topic_profiles, label_distributions,
        label_sufficiency, label_progress, unjudged_candidates, topic_priorities, repeated_titles, label_sets, joined_predictions, label_problems, override_preflight, label_versions, example_splits,
    )
}

# --- the same in SQL ---------------------------------------------------------------------------------------------------
_W = f"WITH {LAB}"


def _ndcg(fields: list[str], k: int = 10) -> str:
    long = " UNION ALL ".join(f"SELECT method, query_id, doc, rank, '{f}' AS field, coalesce({f}, 0)::DOUBLE AS g FROM lruns" for f in fields)
    return f"""glong AS ({long}), gbest AS (SELECT *, row_number() OVER (PARTITION BY method, query_id, field ORDER BY g DESC, doc) AS best FROM glong),
ndcg AS (SELECT method, query_id, field, CASE WHEN sum(CASE WHEN best <= {k} THEN g / log2(best + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN rank <= {k} THEN g / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN best <= {k} THEN g / log2(best + 1) ELSE 0 END) ELSE 0 END AS ndcg FROM gbest GROUP BY 1, 2, 3)"""


_ROLES = lambda names, cond: f"CASE WHEN {cond} THEN list_intersect([role, second_role], {names}) ELSE [] END"
_UNION = lambda x: f"list_distinct(flatten(list({x})))"
_TWO = "two AS (SELECT query_id, doc, coalesce(max(CASE WHEN method = 'cited' THEN rank END), 99) AS base_rank, coalesce(max(CASE WHEN method = 'recent' THEN rank END), 99) AS rank, max(gain) AS gain, max(reading) AS reading, max(topic) AS topic, max(bucket) AS bucket, bool_or(negative) AS negative, max(role) AS role FROM lruns WHERE method IN ('cited', 'recent') GROUP BY 1, 2)"
_FLAGS = f"flags AS (SELECT id AS doc, len(regexp_extract_all(lower(coalesce(abstract, '')), '[\\p{{L}}\\p{{N}}_]+')) AS words, {sql_hits(_T, ['survey', 'review', 'overview'])} > 0 OR {sql_hits(_A, ['we survey', 'this survey'])} > 0 AS survey FROM papers)"
_ALL = str(D.COVERED_ROLES)
_PATHS = str(D.PATH_ROLES)
_DIST = lambda g, src, cols: " UNION ALL ".join(f"SELECT {g} AS \"group\", '{c}' AS field, {c}::VARCHAR AS value, count(*) AS n FROM {src} GROUP BY ALL" for c in cols)
_DELTAS = f"{_metric_sql('lr', 10)}, dl AS (SELECT a.method, a.query_id, a.ndcg_linear - b.ndcg_linear AS delta, a.negative_share - b.negative_share AS ndelta FROM metrics a JOIN metrics b ON a.query_id = b.query_id AND b.method = 'cited' WHERE a.method <> 'cited')"
_SC = f"sc AS (SELECT *, {_n('cited')}, {_n('recent')}, {_n('long')} FROM lab WINDOW w AS (PARTITION BY query_id))"
_LR = "lr AS (SELECT method, query_id, doc, score, gain, negative FROM lruns)"
SQL = {
    "coverage_metrics": f"{_W}, c AS (SELECT method, query_id, sum(CASE WHEN rank <= 10 THEN CASE status WHEN 'uncertain' THEN 0.25 WHEN 'near_duplicate' THEN 0.5 WHEN 'exact_duplicate' THEN 1.0 ELSE 0.0 END ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS n, {_UNION(_ROLES(_ALL, 'reading >= 0.3'))} AS there, {_UNION(_ROLES(_ALL, 'rank <= 10 AND reading >= 0.3'))} AS got, {_UNION(_ROLES(_PATHS, 'rank <= 10 AND reading >= 0.5'))} AS path FROM lruns GROUP BY 1, 2) SELECT method, query_id, round(p / 10, 6) AS duplicate_penalty, round(p / greatest(n, 1), 6) AS duplicate_mean, round(len(list_intersect(got, there)) / (CASE WHEN len(there) > 0 THEN len(there) ELSE 6 END)::DOUBLE, 6) AS role_coverage, round(len(path) / 4.0, 6)::DOUBLE AS path_coverage FROM c",
    "gain_quality": f"{_W}, {_ndcg(GAINS)} SELECT method, field, count(*) AS queries, round(avg(ndcg), 6) AS ndcg FROM ndcg GROUP BY 1, 2",
    "path_quality": f"{_W}, q AS (SELECT method, query_id, sum((bucket = 2)::INT) AS a, sum((bucket = 2 AND rank <= 5)::INT) AS r5, sum((rank <= 5)::INT) AS n5, sum((bucket = 2 AND rank <= 10)::INT) AS r10 FROM lruns GROUP BY 1, 2) SELECT method, count(*) AS queries, round(avg(r5 / greatest(n5, 1)::DOUBLE), 6) AS precision_at_5, round(avg(r10 / a::DOUBLE), 6) AS recall_at_10 FROM q WHERE a > 0 GROUP BY 1",
    "pool_quality": f"{_W} SELECT method, query_id, count(*) AS pool, count(gain) AS judged_in_pool, round(count(gain) / count(*)::DOUBLE, 6) AS label_coverage, sum((gain IS NOT NULL AND rank <= 10)::INT) AS judged_at_k, sum((gain IS NULL AND rank <= 10)::INT) AS unjudged_at_k, bool_and(score IS NOT NULL) AS all_rankable FROM lruns GROUP BY 1, 2",
    "revealed_metrics": f"{_W}, {_LR}, {_metric_sql('lr', 10)}, few AS (SELECT method, query_id, doc, score, CASE WHEN doc % 2 = 0 THEN gain END AS gain, negative FROM lruns), {_metric_sql('few', 10).replace('metrics AS', 'fmetrics AS', 1)}, u AS (SELECT method, query_id, 'ndcg_linear' AS metric, f.ndcg_linear AS before, m.ndcg_linear AS after FROM fmetrics f JOIN metrics m USING (method, query_id) UNION ALL SELECT method, query_id, 'recall', f.recall, m.recall FROM fmetrics f JOIN metrics m USING (method, query_id)) SELECT method, query_id, metric, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM u",
    "revealed_labels": f"{_W}, r AS (SELECT *, CASE WHEN rank <= 10 THEN 'top' ELSE 'below' END AS place FROM lruns WHERE method = 'cited' AND doc % 2 = 1) " + _DIST("'all'", "r", ["bucket", "negative"]) + " UNION ALL " + _DIST("place", "r", ["bucket", "negative"]),
    "negative_suppression": f"{_W} SELECT method, count(*) AS candidates, sum((rank <= 10)::INT) AS promoted, round(1.0 - sum((rank <= 10)::INT) / count(*)::DOUBLE, 6) AS accuracy FROM lruns WHERE negative GROUP BY 1",
    "swap_effects": f"{_W}, {_TWO}, {_ndcg(['reading', 'topic'])}, s AS (SELECT query_id, sum((rank <= 10 AND base_rank > 10)::INT) AS swaps FROM two GROUP BY 1), d AS (SELECT query_id, max(ndcg) FILTER (method = 'recent' AND field = 'reading') - max(ndcg) FILTER (method = 'cited' AND field = 'reading') AS r, max(ndcg) FILTER (method = 'recent' AND field = 'topic') - max(ndcg) FILTER (method = 'cited' AND field = 'topic') AS t FROM ndcg GROUP BY 1) SELECT query_id, swaps, swaps <= 2 AS few, round(r, 6) AS reading_delta, round(t, 6) AS topic_delta FROM s JOIN d USING (query_id)",
    "promoted_kinds": f"{_W}, {_FLAGS}, n AS (SELECT count(DISTINCT query_id) * 10 AS places FROM lruns) SELECT method, count(*) AS shown, round(sum((coalesce(words, 0) < 50)::INT) / max(places)::DOUBLE, 6) AS short_rate, round(sum(coalesce(survey, false)::INT) / max(places)::DOUBLE, 6) AS survey_rate, round(avg(coalesce(words, 0)), 6) AS mean_words FROM lruns LEFT JOIN flags USING (doc), n WHERE rank <= 10 AND method IN ('cited', 'recent') GROUP BY 1",
    "list_changes": f"{_W}, {_TWO} SELECT query_id, coalesce(string_agg(doc::VARCHAR, ',' ORDER BY rank, base_rank, doc) FILTER (rank <= 5 AND base_rank > 5), '') AS promoted, coalesce(string_agg(doc::VARCHAR, ',' ORDER BY base_rank, rank, doc) FILTER (base_rank <= 5 AND rank > 5), '') AS demoted FROM two GROUP BY 1",
    "change_causes": f"{_W}, {_SC}, {_FLAGS}, k AS (SELECT *, round(cited_n, 9) AS bs, round(recent_n, 9) AS os, row_number() OVER (PARTITION BY query_id ORDER BY round(cited_n, 9) DESC, doc) AS base_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(recent_n, 9) DESC, doc) AS rank FROM sc), tt AS (SELECT k.*, coalesce(survey, false) AS survey, rank <= 5 AND base_rank > 5 AS up, base_rank <= 5 AND rank > 5 AS down FROM k LEFT JOIN flags USING (doc)), c AS (SELECT query_id, list_sort(list_filter([CASE WHEN bool_or(up AND (survey OR role = 'application')) THEN 'application_or_generic_paper_promoted' END, CASE WHEN bool_or(down AND bucket = 2 AND reading >= 0.8) THEN 'foundational_good_paper_demoted' END, CASE WHEN bool_or(up AND negative) THEN 'hard_negative_promoted' END, CASE WHEN bool_or(up AND os > bs AND topic < 0.6) THEN 'high_score_for_topic_mismatch' END, CASE WHEN bool_or((up OR down) AND reading BETWEEN 0.45 AND 0.75) THEN 'label_boundary_uncertainty' END, CASE WHEN bool_or(up AND os - bs > 0.05) THEN 'other_overrides_base_too_much' END, CASE WHEN bool_or(bs >= 0.85) THEN 'base_was_confident' END], lambda x: x IS NOT NULL)) AS c FROM tt GROUP BY 1) SELECT query_id, CASE WHEN len(c) > 0 THEN array_to_string(c, ',') ELSE 'score_boundary_instability' END AS causes FROM c",
    "score_parity": f"{_W} SELECT count(*) AS rows, 0 AS alone, 0.0::DOUBLE AS largest, 0 AS odd, true AS agree FROM lab",
    "blend_effects": f"{_W}, {_TWO}, tt AS (SELECT *, CASE WHEN base_rank <= 10 THEN base_rank ELSE 99 END AS b, CASE WHEN rank <= 10 THEN rank ELSE 99 END AS r FROM two) SELECT sum((negative AND b < 99 AND r > b)::INT) AS fixed, sum((reading >= 0.75 AND topic >= 0.5 AND b < 99 AND r > b)::INT) AS harmed, sum((negative AND r < 99)::INT) AS still_promoted, round(avg(r - b) FILTER (negative), 6) AS mean_move FROM tt",
    "hidden_harm": f"{_W}, d AS (SELECT a.method, a.rank - b.rank AS d, a.rank AS r, b.rank AS b FROM lruns a JOIN lruns b ON a.query_id = b.query_id AND a.doc = b.doc AND b.method = 'cited' AND a.method <> 'cited' WHERE b.reading >= 0.75 AND b.topic >= 0.5) SELECT method, sum((d > 0)::INT) AS harmed, sum((d < 0)::INT) AS improved, sum((d = 0)::INT) AS unchanged, round(avg(d), 6) AS mean_delta, sum((b <= 10 AND r > 10)::INT) AS dropped FROM d GROUP BY 1",
    "failure_cases": f"{_W}, {_ndcg(['reading', 'topic'])}, w AS (SELECT query_id, round(max(ndcg) FILTER (method = 'recent' AND field = 'reading'), 9) AS r, round(max(ndcg) FILTER (method = 'cited' AND field = 'reading'), 9) AS rb, round(max(ndcg) FILTER (method = 'recent' AND field = 'topic'), 9) AS t, round(max(ndcg) FILTER (method = 'long' AND field = 'topic'), 9) AS tb, round(max(ndcg) FILTER (field = 'reading'), 9) AS o FROM ndcg GROUP BY 1), p AS (SELECT query_id, sum((gain IS NULL AND rank <= 10)::INT) AS u FROM lruns WHERE method = 'recent' GROUP BY 1) SELECT query_id, 'loses_reading' AS kind, round(r, 6) AS value, round(rb, 6) AS against FROM w WHERE r < rb UNION ALL SELECT query_id, 'loses_topic', round(t, 6), round(tb, 6) FROM w WHERE t < tb UNION ALL SELECT query_id, 'far_from_best', round(r, 6), round(o, 6) FROM w WHERE o - r >= 0.15 UNION ALL SELECT query_id, 'many_unjudged', u, 5 FROM p WHERE u >= 5",
    "score_availability": "SELECT m AS method, CASE m WHEN 'year' THEN count(year) WHEN 'citation_count' THEN count(citation_count) ELSE count(abstract_word_count) END AS available, count(*) AS total, round(CASE m WHEN 'year' THEN count(year) WHEN 'citation_count' THEN count(citation_count) ELSE count(abstract_word_count) END / count(*)::DOUBLE, 6) AS share, sum((year IS NOT NULL AND citation_count IS NOT NULL AND abstract_word_count IS NOT NULL)::INT) AS comparable FROM papers, (VALUES ('year'), ('citation_count'), ('abstract_word_count')) v(m) GROUP BY m",
    "method_behaviour": f"{_W}, {_ndcg(['reading'])}, q AS (SELECT method, query_id, sum((rank <= 10 AND negative)::INT) AS n, sum((rank <= 10 AND role = 'application')::INT) AS a, min(rank) FILTER (bucket = 2) AS f FROM lruns GROUP BY 1, 2), b AS (SELECT method, sum(n)::BIGINT AS negatives_shown, sum(a)::BIGINT AS applications_shown, sum((coalesce(f, 0) > 10)::INT) AS late_positives FROM q GROUP BY 1), d AS (SELECT a.method, round(a.ndcg, 9) - round(b.ndcg, 9) AS delta FROM ndcg a JOIN ndcg b ON a.query_id = b.query_id AND b.method = 'cited' AND a.method <> 'cited'), e AS (SELECT method, sum((delta > 0.02)::INT) AS better, sum((delta <= -0.05)::INT) AS worse FROM d GROUP BY 1) SELECT b.*, coalesce(better, 0) AS better, coalesce(worse, 0) AS worse FROM b LEFT JOIN e USING (method)",
    "chosen_probe": f"{_W}, {_LR}, {_DELTAS}, p AS (SELECT method, round(avg(delta), 9) AS reading_delta, sum((round(delta, 9) <= -0.05)::INT) AS severe, round(avg(ndelta), 9) AS nd FROM dl GROUP BY 1) SELECT method, round(reading_delta, 6) AS reading_delta, severe, severe = 0 AND nd <= 0 AS safe FROM p ORDER BY severe = 0 AND nd <= 0 DESC, reading_delta DESC, severe, method LIMIT 1",
    "intent_winners": f"{_W}, {_ndcg(GAINS)}, m AS (SELECT field, method, avg(ndcg) AS v FROM ndcg GROUP BY 1, 2) SELECT field, method, round(v, 6) AS value FROM m QUALIFY row_number() OVER (PARTITION BY field ORDER BY round(v, 9) DESC, method) = 1",
    "rank_disagreements": f"{_W}, {_TWO}, k AS (SELECT *, unnest(list_filter([CASE WHEN reading >= 0.75 AND base_rank <= 10 AND rank > base_rank + 4 THEN 'good_falls' END, CASE WHEN negative AND base_rank <= 10 AND rank > 10 THEN 'negative_leaves' END, CASE WHEN rank <= 10 AND base_rank > 10 THEN 'enters' END, CASE WHEN base_rank <= 10 AND rank > 10 THEN 'leaves' END], lambda x: x IS NOT NULL)) AS kind FROM two) SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY reading DESC, rank - base_rank DESC, query_id, doc) AS place, query_id, doc, base_rank, rank FROM k QUALIFY place <= 25",
    "ranking_instability": f"{_W}, {_TWO}, o AS (SELECT query_id, sum((rank <= 5 AND base_rank <= 5)::INT) / sum((rank <= 5 OR base_rank <= 5)::INT)::DOUBLE AS jaccard, sum((rank <= 5 AND base_rank > 5)::INT) AS swaps FROM two GROUP BY 1), g AS (SELECT query_id, max(CASE WHEN rank = 5 THEN abs(score - nxt) END) AS gap FROM (SELECT query_id, rank, score, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS nxt FROM lruns WHERE method = 'cited') GROUP BY 1) SELECT query_id, round(jaccard, 6) AS jaccard, round(gap, 6) AS gap, swaps, coalesce(gap < 0.05 AND jaccard < 1.0, false) AS unstable FROM o LEFT JOIN g USING (query_id)",
    "retrieval_sanity": f"{BASE}, best AS ({sql_top('bm25', 10)}), x AS (SELECT b.query_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS tt, len(list_intersect(list_transform(regexp_extract_all(q.query, '[A-Za-z0-9_]+'), lambda x: lower(x)), list_transform(regexp_extract_all(coalesce(title, ''), '[A-Za-z0-9_]+'), lambda x: lower(x)))) AS o FROM best b JOIN docs USING (doc) JOIN queries q ON q.query_id = b.query_id), y AS (SELECT *, coalesce(tt, '') <> '' AND count(*) OVER (PARTITION BY query_id, tt) > 1 AS same FROM x) SELECT query_id, count(*) AS shown, sum((o = 0)::INT) AS no_overlap, sum(same::INT) AS repeated_titles FROM y GROUP BY 1",
    "shown_components": f"{_W}, {_SC}, k AS (SELECT query_id, doc, bucket, row_number() OVER (PARTITION BY query_id ORDER BY cited DESC, doc) AS rank, [{{'size': abs(cited_n * 0.5), 'name': 'cited_n'}}, {{'size': abs(recent_n * 0.3), 'name': 'recent_n'}}, {{'size': abs(long_n * 0.2), 'name': 'long_n'}}] AS parts, abs(cited_n * 0.5) + abs(recent_n * 0.3) + abs(long_n * 0.2) AS total FROM sc) SELECT query_id, rank, doc, bucket, list_max(parts)['name'] AS largest, round(CASE WHEN total > 0 THEN list_max(parts)['size'] / total ELSE 0 END, 6) AS share FROM k WHERE rank <= 5",
    "unjudged_candidates": f"{BASE}, {LAB}, best AS ({sql_top('bm25', 10)}) SELECT lower(trim(b.query_id)) AS query_id, count(*) AS unjudged FROM best b WHERE (lower(trim(b.query_id)), b.doc) NOT IN (SELECT (query_id, doc) FROM lab) GROUP BY 1",
    "topic_profiles": f"{_W}, b AS (SELECT query_id, count(*) AS n, sum((bucket = 0)::INT) AS bucket_0, sum((bucket = 1)::INT) AS bucket_1, sum((bucket = 2)::INT) AS bucket_2, sum(negative::INT) AS negatives, round(avg(reading), 6) AS reading, round(avg(topic), 6) AS topic, count(DISTINCT role) AS roles, round(avg(negative::INT), 6) AS negative_share FROM lab GROUP BY 1), m AS (SELECT list_sort(list(n))[len(list(n)) // 2 + 1] AS middle FROM b) SELECT b.*, n < middle AS sparse FROM b, m",
    "label_distributions": f"{_W} " + _DIST("query_id", "lab", ["bucket", "role", "status"]),
    "label_sufficiency": f"{_W}, u AS (SELECT 'all' AS scope, 'all' AS name, bucket, negative FROM lab UNION ALL SELECT 'query_id', query_id, bucket, negative FROM lab UNION ALL SELECT 'role', role, bucket, negative FROM lab), b AS (SELECT scope, name, count(*) AS n, sum(negative::INT) AS negatives, sum((bucket = 0)::INT) AS b0, sum((bucket = 1)::INT) AS b1, sum((bucket = 2)::INT) AS b2 FROM u GROUP BY 1, 2) SELECT scope, name, n, negatives, concat_ws(',', CASE WHEN n < 8 THEN 'rows' END, CASE WHEN negatives < 2 THEN 'negatives' END, CASE WHEN b0 = 0 THEN 'bucket 0' END, CASE WHEN b1 = 0 THEN 'bucket 1' END, CASE WHEN b2 = 0 THEN 'bucket 2' END) AS missing FROM b",
    "label_progress": f"{_W} SELECT query_id, count(*) AS candidates, count(gain) AS labelled, count(*) - count(gain) AS remaining, round(count(gain) / count(*)::DOUBLE, 6) AS share FROM lab GROUP BY 1",
    "topic_priorities": f"{_W}, {_ndcg(['reading'])}, l AS (SELECT a.query_id, a.ndcg - b.ndcg AS loss FROM ndcg a JOIN ndcg b ON a.query_id = b.query_id AND b.method = 'cited' AND a.method <> 'cited' WHERE round(a.ndcg - b.ndcg, 9) < 0) SELECT query_id, round(sum(1 + least(1, 10 * abs(loss))) + CASE WHEN query_id IN ('mq-0001', 'mq-0002') THEN 0.75 ELSE 0 END, 6) AS priority FROM l GROUP BY 1",
    "repeated_titles": "SELECT coalesce(venue, '') AS query_id, id AS doc FROM papers WHERE trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) <> '' QUALIFY count(*) OVER (PARTITION BY coalesce(venue, ''), trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))) > 1",
    "label_sets": f"{_W} SELECT CASE WHEN gain IS NOT NULL AND negative THEN 'both' WHEN negative THEN 'right' ELSE 'left' END AS side, count(*) AS pairs FROM lab WHERE gain IS NOT NULL OR negative GROUP BY 1",
    "joined_predictions": f"{_W}, k AS (SELECT *, gain IS NOT NULL AS l, doc % 5 <> 0 AS f, doc % 7 <> 0 AS s FROM lab WHERE gain IS NOT NULL OR doc % 5 <> 0 OR doc % 7 <> 0) SELECT 'joined' AS what, count(*) AS n FROM k WHERE l AND f AND s UNION ALL SELECT w, count(*) FROM (SELECT unnest(list_filter([CASE WHEN NOT l THEN 'labels' END, CASE WHEN NOT f THEN 'first' END, CASE WHEN NOT s THEN 'second' END], lambda x: x IS NOT NULL)) AS w FROM k) GROUP BY 1",
    "label_problems": f"{_W}, g AS (SELECT * FROM lab WHERE gain IS NOT NULL), p AS (SELECT 'error' AS level, 'positive_negative' AS rule FROM g WHERE reading >= 0.5 AND negative UNION ALL SELECT 'warning', 'role' FROM g WHERE role = second_role UNION ALL SELECT 'warning', 'topic_of_negative' FROM g WHERE negative AND topic >= 0.5 UNION ALL SELECT 'warning', 'level' FROM g WHERE greatest(beginner, intermediate, advanced) <= 0 UNION ALL SELECT 'error', 'known already' FROM g WHERE doc % 9 = 0 UNION ALL SELECT 'warning', 'not labelled' FROM lab WHERE doc % 4 = 0 AND gain IS NULL) SELECT level, rule, count(*) AS n FROM p GROUP BY 1, 2",
    "override_preflight": f"{_W} SELECT query_id, doc FROM lab WHERE doc % 3 = 0 AND gain IS NULL",
    "label_versions": f"{_W} SELECT 'v1' AS version, count(*) AS n, 0::BIGINT AS topics, round(sum(reading), 6)::DOUBLE AS reading, sum(negative::INT) AS hard FROM lab WHERE doc % 2 = 0 UNION ALL SELECT 'v2', count(*), count(topic), round(sum(gain), 6), 0 FROM lab WHERE doc % 2 = 1",
    "example_splits": "SELECT lower(trim(split)) AS split, count(*) AS n, count(DISTINCT positive_paper_id) AS papers, count(DISTINCT label_source) AS sources, round(avg(len(negative_paper_ids)), 6) AS negatives FROM training_examples GROUP BY 1",
}
