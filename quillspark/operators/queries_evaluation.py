"""Score scaling, blends, ranking quality and comparisons over judged pairs of training examples and papers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import evaluation as E
from quillspark.operators import fusion as X
from quillspark.operators import ranking as N
from quillspark.runtime import load

METRICS = ["recall", "precision", "mrr", "mrr_at_k", "ndcg_binary", "ndcg_linear", "ndcg_exponential", "negative_share", "negatives_per_k", "judged", "unjudged"]
#: Gain of a positive by the way it was labelled.
GAINS = {"manual": 1.0, "citation_graph": 0.75, "co_citation": 0.5}
OTHER_GAIN = 0.25
GRID = [{"cited_n": 1.0, "recent_n": 0.0, "long_n": 0.0}, {"cited_n": 0.6, "recent_n": 0.3, "long_n": 0.1}, {"cited_n": 0.2, "recent_n": 0.4, "long_n": 0.4}]


def judged(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, doc, cited, recent, long, gain, negative): papers named by the training examples of a manual query, three
    plain scores of each, its largest gain, and whether it was drawn as a negative."""
    t = load(spark, d, "training_examples").select(F.lower(F.trim("query_id")).alias("query_id"), "positive_paper_id", "negative_paper_ids", "label_source")
    gain = reduce(lambda acc, kv: acc.when(F.col("label_source") == kv[0], kv[1]), GAINS.items(), F.when(F.lit(False), 0.0)).otherwise(OTHER_GAIN)
    pos = t.select("query_id", F.col("positive_paper_id").alias("doc"), gain.alias("gain"), F.lit(0).alias("neg"))
    neg = t.select("query_id", F.explode("negative_paper_ids").alias("doc"), F.lit(None).cast("double").alias("gain"), F.lit(1).alias("neg"))
    known = load(spark, d, "manual_queries").select(F.lower(F.trim("query_id")).alias("query_id")).distinct()
    pairs = pos.unionByName(neg).join(known, "query_id", "left_semi").groupBy("query_id", "doc").agg(F.max("gain").alias("gain"), (F.max("neg") == 1).alias("negative"))
    papers = load(spark, d, "papers").select(F.col("id").alias("doc"), F.log1p(F.greatest(F.coalesce("citation_count", F.lit(0)), F.lit(0))).alias("cited"), F.coalesce(F.col("year").cast("double"), F.lit(0.0)).alias("recent"), F.length(F.coalesce("abstract", F.lit(""))).cast("double").alias("long"))
    return pairs.join(papers, "doc").select("query_id", "doc", "cited", "recent", "long", "gain", "negative")


def runs(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d)
    return j.select("query_id", "doc", "gain", "negative", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in ("cited", "recent", "long")])))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.per_query(runs(spark, d), 10)


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _r(_metrics(spark, d), *METRICS[:9])


def metrics_pool_ideal(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.per_query(runs(spark, d), 5, ideal="top").select("method", "query_id", "ndcg_linear", "ndcg_exponential", "recall"), "ndcg_linear", "ndcg_exponential", "recall")


def metrics_macro(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.macro_average(_metrics(spark, d), METRICS), "mean", "deviation", "least", "most")


def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.deltas(_metrics(spark, d), "ndcg_linear", "cited"), "value", "base", "delta")


def win_loss(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.wins(E.deltas(_metrics(spark, d), "ndcg_linear", "cited"), eps=1e-9), "mean_delta", "without_best")


def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.without_one(E.deltas(_metrics(spark, d), "ndcg_linear", "cited")), "mean_without")


def method_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.top_overlap(runs(spark, d), "cited", "recent", 5), "jaccard")


def promotions(spark: SparkSession, d: str) -> DataFrame:
    return E.moves(runs(spark, d), "cited", "recent", 5)


def preference_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return E.pair_accuracy(runs(spark, d), positive=0.25)


def best_method(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d).withColumn("ndcg_linear", F.round("ndcg_linear", 9))
    return _r(E.oracle_gap(m, "ndcg_linear"), "best", "worst", "gap")


def score_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.nearest_rank(runs(spark, d), "method", "score", [0.05, 0.5, 0.9, 0.95]), "value")


def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.calibration(X.scaled(judged(spark, d), "query_id", ["cited"]), "cited_n", "gain"), "mean_score", "mean_gain")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(X.scaled(judged(spark, d), "query_id", ["cited"]), "cited_n", "gain")


def score_correlations(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.correlations(judged(spark, d).where("gain is not null"), ["cited", "recent", "long", "gain"]), "r")


def score_rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.rank_correlation(judged(spark, d), "query_id", "cited", "long"), "rho")


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.summary(runs(spark, d), "method", "score"), "least", "most", "mean", "deviation")


def scope_counts(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "training_examples")
    return E.scope_split(t, "label_source").groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("positive_paper_id").alias("papers"))


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.bootstrap(E.deltas(_metrics(spark, d), "ndcg_linear", "cited")), "mean", "low", "high")


def normalisers(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d)
    a = N.max_normal(j, "query_id", "cited").withColumnRenamed("normal", "by_max")
    b = N.minmax_normal(a, "query_id", "cited").withColumnRenamed("normal", "by_ends")
    c = N.minmax_normal(b, "query_id", "cited", 0.5, 1e-12).withColumnRenamed("normal", "by_ends_half")
    e = N.z_normal(c, "query_id", "cited").withColumnRenamed("normal", "by_deviation")
    return _r(e.select("query_id", "doc", "by_max", "by_ends", "by_ends_half", "by_deviation"), "by_max", "by_ends", "by_ends_half", "by_deviation")


def margins(spark: SparkSession, d: str) -> DataFrame:
    return _r(N.margin_to(judged(spark, d), "query_id", 10, "cited").select("query_id", "doc", "rank", "margin"), "margin")


def rank_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _r(N.gap_at(judged(spark, d), "query_id", 3, "cited"), "gap")


def score_spread(spark: SparkSession, d: str) -> DataFrame:
    s = X.scaled(judged(spark, d), "query_id", ["cited", "recent", "long"])
    return _r(s.select("query_id", "doc", N.spread([F.col("cited_n"), F.col("recent_n"), F.col("long_n")]).alias("spread")), "spread")


def guarded_blend(spark: SparkSession, d: str) -> DataFrame:
    s = X.scaled(judged(spark, d), "query_id", ["cited", "recent", "long"])
    c, r, t = F.col("cited_n"), F.col("recent_n"), F.col("long_n")
    out = s.select("query_id", "doc", X.guarded(c, r, t).alias("guarded"), X.penalised(c, c, r).alias("penalised"), *[X.filtered_text(c, t, F.greatest(c, r), m).alias(m) for m in ("capped", "unsure", "agreed", "full")])
    return _r(out, "guarded", "penalised", "capped", "unsure", "agreed", "full")


def blend_grid(spark: SparkSession, d: str) -> DataFrame:
    s = X.scaled(judged(spark, d), "query_id", ["cited", "recent", "long"])
    g = X.blend_grid(s, GRID).withColumn("score", F.round("score", 9))
    m = E.per_query(g.withColumn("method", F.col("blend").cast("string")), 10)
    return m.groupBy("method").agg(F.round(F.avg("ndcg_linear"), 6).alias("ndcg"), F.round(F.avg("negative_share"), 6).alias("negative_share"))


def safe_fusion(spark: SparkSession, d: str) -> DataFrame:
    s = X.scaled(judged(spark, d), "query_id", ["cited", "long"])
    return _r(X.swap_limited(s, "query_id", "cited_n", "long_n", 5).select("query_id", "doc", "score", "entrant"), "score")


def fusion_features(spark: SparkSession, d: str) -> DataFrame:
    f = X.fusion_features(judged(spark, d), "query_id", ["cited", "recent", "long"], 10)
    score = X.linear_score({c: F.col(c) for c in ("cited_n", "recent_n", "cited_margin")}, {"cited_n": 0.5, "recent_n": 0.3, "cited_margin": 0.2}, {"cited_n": 0.4}, {"cited_n": 0.25}, 0.1)
    out = f.select("query_id", "doc", "cited_n", "cited_rank", "cited_margin", "cited_minus_recent", "cited_recent_ranks", score.alias("fused"))
    return _r(out, "cited_n", "cited_margin", "cited_minus_recent", "fused")


# --- the same in SQL ---------------------------------------------------------------------------------------------------
_GAIN = "CASE " + " ".join(f"WHEN label_source = '{k}' THEN {v}" for k, v in GAINS.items()) + f" ELSE {OTHER_GAIN} END"
JUDGED = f"""t AS (SELECT lower(trim(query_id)) AS query_id, positive_paper_id, negative_paper_ids, {_GAIN} AS gain FROM training_examples),
pairs AS (SELECT query_id, doc, max(gain)::DOUBLE AS gain, max(neg) = 1 AS negative FROM (
  SELECT query_id, positive_paper_id AS doc, gain, 0 AS neg FROM t UNION ALL SELECT query_id, unnest(negative_paper_ids), NULL, 1 FROM t)
  WHERE query_id IN (SELECT lower(trim(query_id)) FROM manual_queries) GROUP BY 1, 2),
judged AS (SELECT query_id, doc, ln(1 + greatest(coalesce(citation_count, 0), 0)) AS cited, coalesce(year, 0)::DOUBLE AS recent, length(coalesce(abstract, ''))::DOUBLE AS long, gain, negative
  FROM pairs JOIN papers ON id = doc),
runs AS (SELECT 'cited' AS method, query_id, doc, cited AS score, gain, negative FROM judged UNION ALL SELECT 'recent', query_id, doc, recent, gain, negative FROM judged
  UNION ALL SELECT 'long', query_id, doc, long, gain, negative FROM judged)"""


def _metric_sql(source: str, k: int, top: bool = False) -> str:
    ratio = "CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0 END"
    dcg = lambda g, r: f"sum(CASE WHEN {r} <= {k} THEN {g} / log2({r} + 1) ELSE 0 END)"
    rel = "CASE WHEN g >= 0.5 THEN 1.0 ELSE 0 END"
    hit = f"sum(CASE WHEN g >= 0.5 AND rank <= {k} THEN 1.0 ELSE 0 END)"
    size, neg = f"sum(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END)", f"sum(CASE WHEN rank <= {k} AND coalesce(negative, false) THEN 1.0 ELSE 0 END)"
    cut = f"WHERE rank <= {k}" if top else ""
    return f"""metrics AS (SELECT method, query_id, {ratio.format(hit, f'sum({rel})')} AS recall, {hit} / {k} AS precision, coalesce(1.0 / min(CASE WHEN g >= 0.5 THEN rank END), 0) AS mrr,
  coalesce(1.0 / min(CASE WHEN g >= 0.5 AND rank <= {k} THEN rank END), 0) AS mrr_at_k, {ratio.format(dcg(rel, 'rank'), dcg(rel, 'best'))} AS ndcg_binary,
  {ratio.format(dcg('g', 'rank'), dcg('g', 'best'))} AS ndcg_linear, {ratio.format(dcg('(pow(2, g) - 1)', 'rank'), dcg('(pow(2, g) - 1)', 'best'))} AS ndcg_exponential,
  {ratio.format(neg, size)} AS negative_share, {neg} / {k} AS negatives_per_k, sum(CASE WHEN gain IS NOT NULL AND rank <= {k} THEN 1 ELSE 0 END) AS judged,
  sum(CASE WHEN gain IS NULL AND rank <= {k} THEN 1 ELSE 0 END) AS unjudged
  FROM (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY g DESC, doc) AS best FROM (
    SELECT *, coalesce(gain, 0) AS g, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, doc) AS rank FROM {source}) {cut}) GROUP BY 1, 2)"""


_M = f"WITH {JUDGED}, {_metric_sql('runs', 10)}"
_D = f"{_M}, d AS (SELECT a.method, a.query_id, a.ndcg_linear AS value, b.ndcg_linear AS base, a.ndcg_linear - b.ndcg_linear AS delta FROM metrics a JOIN metrics b ON a.query_id = b.query_id AND b.method = 'cited' WHERE a.method <> 'cited')"
_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, doc) AS rank FROM runs), tops AS (SELECT query_id, doc, max(CASE WHEN method = 'cited' THEN 1 ELSE 0 END) AS l, max(CASE WHEN method = 'recent' THEN 1 ELSE 0 END) AS rr, max(gain) AS gain, bool_or(coalesce(negative, false)) AS negative FROM r WHERE rank <= 5 GROUP BY 1, 2)"


def _n(c: str) -> str:
    lo, hi = f"min({c}) OVER w", f"max({c}) OVER w"
    return f"CASE WHEN {hi} - {lo} <= 1e-12 THEN 0.5 ELSE ({c} - {lo}) / ({hi} - {lo}) END AS {c}_n"


SCALED = f"scaled AS (SELECT *, {_n('cited')}, {_n('recent')}, {_n('long')} FROM judged WINDOW w AS (PARTITION BY query_id))"
_S = f"WITH {JUDGED}, {SCALED}"
_ROUND = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS[:9])

QUERIES = {
    f.__name__: f
    for f in (
        metrics_per_query, metrics_pool_ideal, metrics_macro, metric_deltas, win_loss, leave_one_out, method_overlap, promotions, preference_accuracy, best_method, score_percentiles, calibration_bins,
        confusion_matrix, score_correlations, score_rank_correlation, score_summary, scope_counts, bootstrap_interval, normalisers, margins, rank_gaps, score_spread, guarded_blend, blend_grid, safe_fusion, fusion_features,
    )
}
SQL = {
    "metrics_per_query": f"{_M} SELECT method, query_id, {_ROUND}, judged, unjudged FROM metrics",
    "metrics_pool_ideal": f"WITH {JUDGED}, {_metric_sql('runs', 5, True)} SELECT method, query_id, round(ndcg_linear, 6) AS ndcg_linear, round(ndcg_exponential, 6) AS ndcg_exponential, round(recall, 6) AS recall FROM metrics",
    "metrics_macro": f"{_M}, long AS (" + " UNION ALL ".join(f"SELECT method, '{m}' AS metric, {m}::DOUBLE AS value FROM metrics" for m in METRICS) + ") SELECT method, metric, count(value) AS queries, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(min(value), 6) AS least, round(max(value), 6) AS most FROM long GROUP BY 1, 2",
    "metric_deltas": f"{_D} SELECT method, query_id, round(value, 6) AS value, round(base, 6) AS base, round(delta, 6) AS delta FROM d",
    "win_loss": f"{_D} SELECT method, sum(CASE WHEN delta > 1e-9 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN delta < -1e-9 THEN 1 ELSE 0 END) AS losses, sum(CASE WHEN abs(delta) <= 1e-9 THEN 1 ELSE 0 END) AS ties, sum(CASE WHEN delta <= -0.05 THEN 1 ELSE 0 END) AS severe, round(avg(delta), 6) AS mean_delta, round(CASE WHEN count(*) > 1 THEN (sum(delta) - max(delta)) / (count(*) - 1) END, 6) AS without_best FROM d GROUP BY 1",
    "leave_one_out": f"{_D} SELECT method, query_id, round(CASE WHEN count(*) OVER w > 1 THEN (sum(delta) OVER w - delta) / (count(*) OVER w - 1) END, 6) AS mean_without FROM d WINDOW w AS (PARTITION BY method)",
    "method_overlap": f"WITH {JUDGED}, {_RANKED} SELECT query_id, sum(l * rr) AS both, sum(l * (1 - rr)) AS left_only, sum((1 - l) * rr) AS right_only, round(sum(l * rr) / (sum(l * rr) + sum(l * (1 - rr)) + sum((1 - l) * rr))::DOUBLE, 6) AS jaccard FROM tops WHERE l + rr > 0 GROUP BY 1",
    "promotions": f"WITH {JUDGED}, {_RANKED} SELECT query_id, doc, CASE WHEN rr = 1 THEN 'promoted' ELSE 'demoted' END AS kind, gain, negative FROM tops WHERE l + rr = 1",
    "preference_accuracy": f"WITH {JUDGED}, x AS (SELECT method, query_id, score, coalesce(gain, 0) >= 0.25 AS good, coalesce(negative, false) AND coalesce(gain, 0) < 0.25 AS bad FROM runs) SELECT a.method, count(*) AS pairs, sum(CASE WHEN a.score > b.score THEN 1 ELSE 0 END)::BIGINT AS right FROM x a JOIN x b ON a.method = b.method AND a.query_id = b.query_id AND a.good AND b.bad GROUP BY 1",
    "best_method": f"{_M} SELECT query_id, arg_min(method, (-round(ndcg_linear, 9), method)) AS best_method, round(max(ndcg_linear), 6) AS best, round(min(ndcg_linear), 6) AS worst, round(max(ndcg_linear) - min(ndcg_linear), 6) AS gap FROM metrics GROUP BY 1",
    "score_percentiles": f"WITH {JUDGED}, x AS (SELECT method, score, row_number() OVER (PARTITION BY method ORDER BY score) - 1 AS pos, count(*) OVER (PARTITION BY method) AS n FROM runs WHERE score IS NOT NULL), s AS (SELECT unnest([0.05, 0.5, 0.9, 0.95])::DOUBLE AS share) SELECT method, share, round(score, 6) AS value FROM x, s WHERE pos = round_even(share * (n - 1), 0)",
    "calibration_bins": f"{_S}, b AS (SELECT least(floor(least(greatest(cited_n, 0), 1) * 5), 4)::INT AS bin, * FROM scaled) SELECT i::INT AS bin, count(cited_n) AS n, round(coalesce(avg(cited_n), 0), 6) AS mean_score, round(coalesce(avg(gain), 0), 6) AS mean_gain FROM range(5) x(i) LEFT JOIN b ON bin = i GROUP BY 1",
    "confusion_matrix": f"{_S} SELECT CASE WHEN cited_n >= 0.66 THEN 2 WHEN cited_n >= 0.33 THEN 1 ELSE 0 END AS predicted, CASE WHEN gain >= 0.66 THEN 2 WHEN gain >= 0.33 THEN 1 ELSE 0 END AS actual, count(*) AS n FROM scaled WHERE gain IS NOT NULL GROUP BY 1, 2",
    "score_correlations": f"WITH {JUDGED}, g AS (SELECT * FROM judged WHERE gain IS NOT NULL), x AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM g" for a, b in (("cited", "recent"), ("cited", "long"), ("cited", "gain"), ("recent", "long"), ("recent", "gain"), ("long", "gain"))) + ") SELECT a, b, round(coalesce(r, 0), 6) AS r, abs(coalesce(r, 0)) >= 0.85 AS strong FROM x",
    "score_rank_correlation": f"WITH {JUDGED}, x AS (SELECT query_id, rank() OVER (PARTITION BY query_id ORDER BY cited) + (count(*) OVER (PARTITION BY query_id, cited) - 1) / 2.0 AS a, rank() OVER (PARTITION BY query_id ORDER BY long) + (count(*) OVER (PARTITION BY query_id, long) - 1) / 2.0 AS b FROM judged) SELECT query_id, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) ELSE 0 END, 6) AS rho FROM x GROUP BY 1",
    "score_summary": f"WITH {JUDGED} SELECT method, count(score) AS n, sum(CASE WHEN score IS NULL THEN 1 ELSE 0 END)::BIGINT AS nulls, round(min(score), 6) AS least, round(max(score), 6) AS most, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS deviation FROM runs GROUP BY 1",
    "scope_counts": "SELECT scope, count(*) AS n, count(DISTINCT positive_paper_id) AS papers FROM (SELECT 'combined' AS scope, positive_paper_id FROM training_examples UNION ALL SELECT label_source, positive_paper_id FROM training_examples WHERE label_source IS NOT NULL) GROUP BY 1",
    "bootstrap_interval": f"{_D}, b AS (SELECT method, b, delta, ('0x' || substr(sha256('146:' || query_id || ':' || b), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d, generate_series(1, 500) g(b)), w AS (SELECT method, b, delta, (u > 0.36787944)::INT + (u > 0.73575888)::INT + (u > 0.91969860)::INT + (u > 0.98101184)::INT + (u > 0.99634015)::INT + (u > 0.99940582)::INT AS w FROM b), m AS (SELECT method, b, sum(w * delta) / greatest(sum(w), 1) AS m FROM w GROUP BY 1, 2) SELECT method, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.05), 6) AS low, round(quantile_cont(m, 0.95), 6) AS high FROM m GROUP BY 1",
    "normalisers": f"WITH {JUDGED} SELECT query_id, doc, round(CASE WHEN max(greatest(cited, 0)) OVER w > 0 THEN greatest(cited, 0) / max(greatest(cited, 0)) OVER w ELSE 0 END, 6) AS by_max, round(CASE WHEN max(cited) OVER w - min(cited) OVER w <= 0 THEN 0 ELSE (cited - min(cited) OVER w) / (max(cited) OVER w - min(cited) OVER w) END, 6) AS by_ends, round(CASE WHEN max(cited) OVER w - min(cited) OVER w <= 1e-12 THEN 0.5 ELSE (cited - min(cited) OVER w) / (max(cited) OVER w - min(cited) OVER w) END, 6) AS by_ends_half, round(CASE WHEN stddev_pop(cited) OVER w > 0 THEN (cited - avg(cited) OVER w) / stddev_pop(cited) OVER w ELSE 0 END, 6) AS by_deviation FROM judged WINDOW w AS (PARTITION BY query_id)",
    "margins": f"WITH {JUDGED}, r AS (SELECT query_id, doc, cited, row_number() OVER (PARTITION BY query_id ORDER BY cited DESC, doc) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM judged) SELECT query_id, doc, rank, round(cited - max(CASE WHEN rank = least(10, n) THEN cited END) OVER (PARTITION BY query_id), 6) AS margin FROM r",
    "rank_gaps": f"WITH {JUDGED}, r AS (SELECT query_id, cited, row_number() OVER w AS rank, lead(cited) OVER w AS nxt FROM judged WINDOW w AS (PARTITION BY query_id ORDER BY cited DESC, doc)) SELECT query_id, round(max(CASE WHEN rank = 3 THEN abs(cited - nxt) END), 6) AS gap FROM r GROUP BY 1",
    "score_spread": f"{_S} SELECT query_id, doc, round(greatest(cited_n, recent_n, long_n) - least(cited_n, recent_n, long_n), 6) AS spread FROM scaled",
    "guarded_blend": f"{_S} SELECT query_id, doc, round(0.675 * cited_n + 0.225 * recent_n + CASE WHEN greatest(cited_n, recent_n) < 0.85 THEN 0.1 * long_n ELSE 0 END, 6) AS guarded, round(cited_n - CASE WHEN cited_n >= 0.7 AND recent_n <= 0.25 THEN 0.2 ELSE 0 END, 6) AS penalised, round(cited_n + least(0.1 * long_n, 0.035), 6) AS capped, round(cited_n + CASE WHEN greatest(cited_n, recent_n) < 0.85 THEN 0.1 * long_n ELSE 0 END, 6) AS unsure, round(cited_n + CASE WHEN abs(long_n - cited_n) >= 0.35 THEN 0 ELSE 0.1 * long_n END, 6) AS agreed, round(cited_n + 0.1 * long_n, 6) AS full FROM scaled",
    "blend_grid": f"{_S}, g AS (" + " UNION ALL ".join(f"SELECT '{i}' AS method, query_id, doc, gain, negative, round(cited_n * {g['cited_n']} + recent_n * {g['recent_n']} + long_n * {g['long_n']}, 9) AS score FROM scaled" for i, g in enumerate(GRID)) + f"), {_metric_sql('g', 10)} SELECT method, round(avg(ndcg_linear), 6) AS ndcg, round(avg(negative_share), 6) AS negative_share FROM metrics GROUP BY 1",
    "safe_fusion": f"{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cited_n DESC, doc) AS b, row_number() OVER (PARTITION BY query_id ORDER BY long_n DESC, doc) AS o FROM scaled), l AS (SELECT *, min(CASE WHEN b <= 5 THEN cited_n END) OVER (PARTITION BY query_id) AS last, o <= 5 AND b > 5 AS new FROM r), e AS (SELECT *, new AND row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN new THEN o END ASC NULLS LAST) <= 2 AS entrant FROM l) SELECT query_id, doc, entrant, round(CASE WHEN entrant THEN greatest(cited_n, least(long_n, last + 0.004 * 3)) ELSE cited_n + greatest(least(long_n - cited_n, 0.005), -0.005) END, 6) AS score FROM e",
    "fusion_features": f"{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cited_n DESC, doc) AS cited_rank, row_number() OVER (PARTITION BY query_id ORDER BY recent_n DESC, doc) AS recent_rank, count(*) OVER (PARTITION BY query_id) AS n FROM scaled), m AS (SELECT *, cited_n - max(CASE WHEN cited_rank = least(10, n) THEN cited_n END) OVER (PARTITION BY query_id) AS cited_margin FROM r) SELECT query_id, doc, round(cited_n, 6) AS cited_n, cited_rank, round(cited_margin, 6) AS cited_margin, round(cited_n - recent_n, 6) AS cited_minus_recent, recent_rank - cited_rank AS cited_recent_ranks, round(0.1 + 0.5 * (cited_n - 0.4) / 0.25 + 0.3 * recent_n + 0.2 * cited_margin, 6) AS fused FROM m",
}
