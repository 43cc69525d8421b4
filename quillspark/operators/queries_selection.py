"""Queries of feature tables, selections and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import labels as L
from quillspark.functions.text import normal_title
from quillspark.operators import audits as A
from quillspark.operators import features as V
from quillspark.operators import fusion as X
from quillspark.operators import labelsets as B
from quillspark.operators import learning as M
from quillspark.operators import selection as S
from quillspark.operators.near_titles import near_title_links
from quillspark.operators.queries_evaluation import _n
from quillspark.operators.queries_labels import _A, _T, LAB, labelled, labelled_runs
from quillspark.operators.queries_retrieval import BASE, CITED, documents, query_table, sql_hits, sql_list, sql_top
from quillspark.operators.retrieval import bm25_top, citation_recency_top
from quillspark.runtime import load, materialize

METHODS = ["cited", "recent", "long"]
ENSEMBLE = ["rank_method_count", "score_method_count", "best_rank", "mean_rank", "mean_reciprocal_rank", "rank_std", "lexical_best_rank", "vector_best_rank", "lexical_vector_rank_gap"]


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _short_runs(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of the first five of each method only, so that some candidates lack some."""
    return labelled_runs(spark, d).select("query_id", "doc", "method", "score", "rank").where("rank <= 5")


def rank_features(spark: SparkSession, d: str) -> DataFrame:
    f = V.method_features(_short_runs(spark, d), METHODS, ["cited", "long"], ["recent"])
    return _r(f.withColumn("rank_std", F.round("rank_std", 4)), *[c for c in f.columns if c not in ("query_id", "doc", "rank_std")])


def _text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Best lexical candidates of every query with text and metadata."""
    best = bm25_top(documents(spark, d).select("doc", "text"), query_table(spark, d), 10).select("query_id", "doc")
    p = load(spark, d, "papers").select(
        F.col("id").alias("doc"), "title", "abstract", "year", "citation_count", "venue", "authors", L.provenance(*[F.col(c) for c in ("source", "external_id", "source_url", "url", "doi")]).alias("sources"), "external_id", "doi", "source_url",
        F.lit(None).cast("string").alias("pdf_url"), (F.col("id") % 4 == 0).alias("full_text"), F.when(normal_title(F.col("title")) != "", normal_title(F.col("title"))).alias("t"),
    )
    copies = p.groupBy("t").agg(F.count(F.lit(1)).alias("title_copies")).where("t is not null")
    met = best.join(p, "doc").join(query_table(spark, d), "query_id").join(copies, "t", "left").withColumn("title_copies", F.coalesce("title_copies", F.lit(1)))
    return met.withColumn("query_copies", F.when(F.col("t").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("query_id", "t"))).otherwise(1))


def candidate_features(spark: SparkSession, d: str) -> DataFrame:
    f = V.text_features(_text_pairs(spark, d), 2026)
    return _r(f, *[c for c in f.columns if c not in ("query_id", "doc")])


def regenerated_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks over all documents of a query for the labelled ones; what the lexical run lacks has rank 51."""
    q = query_table(spark, d)
    scores = bm25_top(documents(spark, d).select("doc", "text"), q, 50).withColumn("query_id", F.lower(F.trim("query_id")))
    return _r(V.target_ranks(scores, labelled(spark, d).select("query_id", "doc"), 51), "normal")


def pool_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Results of one retriever for the queries that it answers, of another for the rest."""
    docs, q = documents(spark, d), query_table(spark, d)
    first = bm25_top(docs.select("doc", "text"), q, 5).where(F.length("query_id") > 0).where("right(query_id, 1) in ('1', '3', '5', '7', '9')")
    return _r(V.with_fallback(first, citation_recency_top(docs.select("doc", "text", "year", "citation_count"), q, 5), 5), "score")


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "papers").select(F.lit("all").alias("query_id"), F.col("id").alias("doc"), "year", "citation_count", "references_count")
    m = V.feature_matrix(p, ["year", "citation_count", "references_count", "absent"])
    return m.select("doc", F.array_join("missing", ",").alias("missing"), "digest")


def feature_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _r(V.feature_coverage(load(spark, d, "papers"), ["year", "citation_count", "references_count", "influential_citation_count"]), "share")


def feature_directions(spark: SparkSession, d: str) -> DataFrame:
    return _r(V.direction_audit(labelled(spark, d), "reading", {"cited": 1, "recent": 1, "long": -1, "topic": 1}), "r")


def coefficient_signs(spark: SparkSession, d: str) -> DataFrame:
    model = M.ridge(labelled(spark, d), ["cited"], "reading", 0.0)
    return _r(V.coefficient_audit(model, {"cited": -1}, spark), "coefficient")


def refined_blends(spark: SparkSession, d: str) -> DataFrame:
    s = X.scaled(labelled(spark, d), "query_id", METHODS)
    out = V.refined(F.col("cited_n"), F.col("recent_n"), F.col("cited_n") - F.col("long_n"), F.greatest("cited_n", "long_n"), (F.col("cited_n") < 0.15) & (F.col("long_n") > 0.4))
    names = {k: k.replace(".", "_") for k in out}
    return _r(s.select("query_id", "doc", *[c.alias(names[k]) for k, c in out.items()]), *names.values())


def field_inventory(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "sample_papers").withColumn("ids", F.map_filter(F.create_map(F.lit("doi"), "doi", F.lit("url"), "url"), lambda k, v: v.isNotNull()))
    return V.inventory(s, ["ids"], ["categories"])


def bucket_packets(spark: SparkSession, d: str) -> DataFrame:
    """Three of the most cited, two of the longest and one of the newest of every query, none twice."""
    by = lambda c: [F.desc(c), F.asc("doc")]
    return S.bucket_selection(labelled(spark, d), [("cited", F.col("gain").isNull(), by("cited"), 3), ("long", F.col("long") > 0, by("long"), 2), ("recent", F.lit(True), by("recent"), 1)], 5)


def boundary_packets(spark: SparkSession, d: str) -> DataFrame:
    runs = V.wide_runs(labelled_runs(spark, d).select("query_id", "doc", "method", "rank", "score"), METHODS)
    p = load(spark, d, "papers").select(F.col("id").alias("doc"), "title", "abstract")
    b = S.boundary_candidates(runs.join(p, "doc"), [f"{m}_rank" for m in METHODS], ["manual_000000001"], ["manual_000000002"])
    return b.select("query_id", "doc", F.array_join("reasons", ",").alias("reasons"), "focus", F.round("score", 6).alias("score"))


def audit_packets(spark: SparkSession, d: str) -> DataFrame:
    """Unjudged documents in a top 10 that may be labelled, and how many each first reason leaves out."""
    r = labelled_runs(spark, d).where("rank <= 10").join(load(spark, d, "papers").select(F.col("id").alias("doc"), "abstract"), "doc")
    e = r.select("query_id", "doc", F.concat(F.lit("top of "), "method").alias("reason"), "rank", F.concat("method", F.lpad(F.col("rank").cast("string"), 3, "0")).alias("seen"), "gain", "abstract")
    kept, out = S.audit_packet(e, {"judged": F.col("gain").isNotNull(), "vague": L.vague_abstract(F.col("abstract"))}, {"top of cited": 1, "top of recent": 2, "top of long": 3}, 200)
    rows = kept.select("query_id", F.col("doc").cast("string").alias("doc"), "reason", "rank")
    return rows.unionByName(out.select(F.lit("excluded").alias("query_id"), F.col("excluded").alias("doc"), F.lit("").alias("reason"), F.col("n").alias("rank")))


def topic_anchors(spark: SparkSession, d: str) -> DataFrame:
    return S.anchors(labelled(spark, d), F.when(F.col("bucket") == 2, "strong").when(F.col("negative"), "negative"), [F.desc("cited"), F.asc("doc")])


def patched_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_runs(spark, d).where("method = 'cited' and rank <= 5").select("query_id", F.col("rank").alias("place"), "doc")
    patch = rows.where("place = 2").select("query_id", F.col("doc").alias("old"), (F.col("doc") + 1_000_000).alias("new"))
    return S.patched(rows, patch)


def evidence_packets(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "papers").select(F.col("id").alias("doc"), "abstract")
    r = labelled_runs(spark, d).where("method = 'cited'").join(p, "doc").select("query_id", "doc", F.col("rank").alias("place"), (F.col("doc") % 3 == 0).alias("full_text"), L.vague_abstract(F.col("abstract")).alias("vague"), (F.col("doc") % 6).alias("methods"), F.lit(None).cast("int").alias("best_rank"))
    return S.evidence_selection(r, 4, 2, 8, 2)


def learning_packets(spark: SparkSession, d: str) -> DataFrame:
    runs = V.wide_runs(labelled_runs(spark, d).select("query_id", "doc", "method", "rank", "score"), METHODS)
    signals = runs.withColumns({"disagreement": F.greatest(*[f"{m}_rank" for m in METHODS]) - F.least(*[f"{m}_rank" for m in METHODS]), "boundary": F.when(F.col("cited_rank").between(8, 12), 1.0)})
    return _r(S.active_learning(signals, {"disagreement": 0.1, "boundary": 2.0}, 3), "score")


def balanced_topics(spark: SparkSession, d: str) -> DataFrame:
    """Two val and two test topics with about five hard negatives a side."""
    t = labelled(spark, d).groupBy("query_id").agg(F.sum(F.col("negative").cast("int")).alias("negatives"), *[F.sum((F.col("bucket") == b).cast("int")).alias(f"b{b}") for b in (0, 1, 2)])
    t = materialize(t, "topics")
    val, test = S.balanced_sides(t, 2, 5)
    return t.select(F.when(F.col("query_id").isin(val), "val").when(F.col("query_id").isin(test), "test").otherwise("train").alias("split"), "query_id")


def identity_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Rows that name papers, some by a changed title or a wrong id, against the corpus."""
    p = load(spark, d, "papers").select("id", "title", "year")
    rows = p.select((F.col("id") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("id"), F.when(F.col("id") % 3 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"), "year")
    return A.identity_audit(rows, p)


def alignment_verdict(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "papers").select("id", F.row_number().over(Window.partitionBy("year").orderBy("id")).alias("number"))
    return A.alignment_audit(p, "number", "id")


def source_verdicts(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "papers").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("doi").isNotNull().cast("double")).alias("dois"), F.countDistinct("id").alias("ids"))
    c = A.source_choice(p, {"too few": F.col("n") >= 100, "few dois": F.col("dois") >= 0.5, "repeated ids": F.col("ids") == F.col("n"), "unknown": F.col("source") != "unknown"})
    return c.select("source", F.array_join("reasons", ",").alias("reasons"), "accepted")


def enriched_records(spark: SparkSession, d: str) -> DataFrame:
    """The stored paper of each harvested record by DOI or near title."""
    h, p = load(spark, d, "harvest_records"), load(spark, d, "papers").withColumnRenamed("id", "work_id")
    stored, harvested = (x.select(normal_title(F.col("title")).alias("t")).where("t is not null") for x in (p, h))
    near = near_title_links(stored, 0.9, harvested)
    ways = near.select("a", "b", F.col("ab").alias("similarity")).unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ba").alias("similarity")))
    e = A.enriched(h, p, ways, 0.9)
    return e.groupBy(F.coalesce("how", F.lit("missed")).alias("how")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("work_id").alias("works"))


def held_out_models(spark: SparkSession, d: str) -> DataFrame:
    """Errors of several learners, each fitted without the fold that it predicts."""
    j = labelled(spark, d).where("gain is not null").withColumn("fold", F.pmod(F.col("doc"), F.lit(2)))
    p = materialize(M.leave_one_group_out(j, "fold", METHODS, "gain", ["ridge", "elastic", "logistic", "forest"]), "held-out")
    return p.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("label"))), 4).alias("error"))


def text_ranker(spark: SparkSession, d: str) -> DataFrame:
    """Text and score features of labelled pairs in one fitted model, and what it predicts."""
    p = load(spark, d, "papers").select(F.col("id").alias("doc"), F.concat_ws(" ", "title", "abstract").alias("text"))
    j = labelled(spark, d).join(p, "doc").where("gain is not null")
    return M.text_model(j, "text", METHODS, "gain", 1 << 10).transform(j).select("query_id", "doc", F.round("prediction", 3).alias("prediction"))


QUERIES = {
    f.__name__: f
    for f in (
        rank_features, candidate_features, regenerated_ranks, pool_fallback, feature_matrix, feature_coverage, feature_directions, coefficient_signs, refined_blends, field_inventory, bucket_packets, boundary_packets, audit_packets,
        topic_anchors, patched_lists, evidence_packets, learning_packets, balanced_topics, identity_verdicts, alignment_verdict, source_verdicts, enriched_records, held_out_models, text_ranker,
    )
}

# --- the same in SQL ---------------------------------------------------------------------------------------------------
_W = f"WITH {LAB}"


def _seven(m: str) -> str:
    p = f"max({{0}}) FILTER (method = '{m}')"
    rank, score = p.format("rank"), p.format("score")
    z = lambda x: f"CASE WHEN {score} IS NOT NULL THEN coalesce({p.format(x)}, 0) ELSE 0 END"
    parts = {"rank_present": f"({rank} IS NOT NULL)::INT", "rank": f"coalesce({rank}, 999)", "reciprocal_rank": f"coalesce(1.0 / greatest({rank}, 1), 0)", "score_present": f"({score} IS NOT NULL)::INT", "score_raw": f"coalesce({score}, 0)", "score_minmax": z("mm"), "score_z": z("zz")}
    return ", ".join(f"round(({v})::DOUBLE, 6) AS {m}_{k}" for k, v in parts.items())


_BEST = lambda ms: f"coalesce(min(rank) FILTER (method IN {tuple(ms) if len(ms) > 1 else '(' + repr(ms[0]) + ')'}), 999)::DOUBLE"
_RUNS5 = "s5 AS (SELECT query_id, doc, method, score, rank FROM lruns WHERE rank <= 5), s5n AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS mm, CASE WHEN stddev_pop(score) OVER w > 0 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END AS zz FROM s5 WINDOW w AS (PARTITION BY query_id, method))"
_VAGUE = f"(length(lower(trim(regexp_replace(coalesce(abstract, ''), '\\s+', ' ', 'g')))) < 50 OR list_contains({sql_list(L.VAGUE)}, lower(trim(regexp_replace(coalesce(abstract, ''), '\\s+', ' ', 'g')))))"
_OV = lambda a, b: f"len(list_intersect(list_distinct(regexp_extract_all(lower({a}), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower({b}), '[a-z0-9]+'))))"
_DC = lambda a: f"greatest(len(list_distinct(regexp_extract_all(lower({a}), '[a-z0-9]+'))), 1)"
_NT = lambda a: f"trim(regexp_replace(lower({a}), '[^a-z0-9]+', ' ', 'g'))"
_PROV = "lower(concat_ws(' ', coalesce(source, ''), coalesce(external_id, ''), coalesce(source_url, ''), coalesce(url, ''), coalesce(doi, '')))"
_TEXT_FEATURES = {
    "query_title_overlap_count": _OV("query", "t0"), "query_title_overlap_query_ratio": f"{_OV('query', 't0')} / {_DC('query')}::DOUBLE", "query_title_overlap_title_ratio": f"{_OV('query', 't0')} / {_DC('t0')}::DOUBLE",
    "query_abstract_overlap_count": _OV("query", "a0"), "query_abstract_overlap_query_ratio": f"{_OV('query', 'a0')} / {_DC('query')}::DOUBLE", "query_abstract_overlap_abstract_ratio": f"{_OV('query', 'a0')} / {_DC('a0')}::DOUBLE",
    "query_phrase_in_title": f"({_NT('query')} <> '' AND contains({_NT('t0')}, {_NT('query')}))::INT", "query_phrase_in_abstract": f"({_NT('query')} <> '' AND contains({_NT('a0')}, {_NT('query')}))::INT",
    "title_char_length": "length(t0)", "abstract_char_length": "length(a0)", "title_token_length": "len(regexp_extract_all(lower(t0), '[a-z0-9]+'))", "abstract_token_length": "len(regexp_extract_all(lower(a0), '[a-z0-9]+'))",
    "abstract_missing": "(trim(a0) = '')::INT", "abstract_short": "(len(regexp_extract_all(lower(a0), '[a-z0-9]+')) BETWEEN 1 AND 39)::INT", "year": "coalesce(year, 0)", "paper_age": "CASE WHEN year > 0 THEN greatest(2026 - year, 0) ELSE 0 END",
    "log_citation_count": "ln(1 + greatest(coalesce(citation_count, 0), 0))", "venue_present": "(coalesce(venue, '') <> '')::INT", "author_count": "coalesce(len(authors), 0)", "source_count": "len(src)",
    "source_arxiv": "list_contains(src, 'arxiv')::INT", "source_openalex": "list_contains(src, 'openalex')::INT", "source_seed": "list_contains(src, 'seed')::INT", "has_arxiv_id": "starts_with(lower(coalesce(external_id, '')), 'arxiv:')::INT",
    "has_doi": "(coalesce(doi, '') <> '')::INT", "has_openalex_id": "starts_with(lower(coalesce(external_id, '')), 'openalex:')::INT", "has_source_url": "(coalesce(source_url, '') <> '')::INT", "has_pdf_url": "0", "fulltext_available": "(doc % 4 = 0)::INT",
    "evidence_title_abstract": "(doc % 4 <> 0 AND trim(a0) <> '')::INT", "evidence_title_abstract_intro_conclusion": "(doc % 4 = 0)::INT", "duplicate_title_cluster_present": "(tc > 1)::INT", "duplicate_title_cluster_size": "tc", "normalized_title_duplicate": "(qc > 1)::INT",
}
_REF = {f"cap_{str(c).replace('.', '_')}": f"cited_n + greatest(least(recent_n - cited_n, {c}), -{c})" for c in (0.01, 0.02, 0.03)}
_REF |= {f"gate_{k}": f"CASE WHEN greatest(cited_n, long_n) >= {c} THEN cited_n ELSE 0.8 * cited_n + 0.2 * recent_n END" for k, c in (("0_85", 0.85), ("0_9", 0.9))}
_REF |= {f"doubt_{k}": f"cited_n + CASE WHEN abs(cited_n - long_n) > {c} THEN 0.05 ELSE 0.2 END * (recent_n - cited_n)" for k, c in (("0_25", 0.25), ("0_35", 0.35))}
_REF["pattern"] = "cited_n + greatest(least(recent_n - cited_n, 0.025), -0.025) - CASE WHEN cited_n < 0.15 AND long_n > 0.4 THEN 0.04 ELSE 0 END"
_REF |= {f"mix_{k}": f"{1 - w} * cited_n + {w} * recent_n" for k, w in ((10, 0.1), (20, 0.2), (30, 0.3), (50, 0.5))}
_WIDE = "wr AS (SELECT query_id, doc, max(rank) FILTER (method = 'cited') AS c, max(rank) FILTER (method = 'recent') AS r, max(rank) FILTER (method = 'long') AS l FROM lruns GROUP BY 1, 2)"
_HEX = lambda *cols: "sha256(array_to_string([" + ", ".join(f"(coalesce({c}, 0)::BIGINT * 1000000)::VARCHAR" for c in cols) + ", '0'], ',') || '|' || array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in cols) + ", 'absent'], lambda x: x IS NOT NULL), ','))"
_PC = ("year", "citation_count", "references_count")
SQL = {
    "rank_features": f"{_W}, {_RUNS5} SELECT query_id, doc, {', '.join(_seven(m) for m in METHODS)}, count(rank)::DOUBLE AS rank_method_count, count(score)::DOUBLE AS score_method_count, min(rank)::DOUBLE AS best_rank, round(avg(rank), 6) AS mean_rank, round(avg(1.0 / rank), 6) AS mean_reciprocal_rank, round(stddev_pop(rank), 4) AS rank_std, {_BEST(['cited', 'long'])} AS lexical_best_rank, {_BEST(['recent'])} AS vector_best_rank, {_BEST(['cited', 'long'])} - {_BEST(['recent'])} AS lexical_vector_rank_gap FROM s5n GROUP BY 1, 2",
    "candidate_features": f"{BASE}, best AS ({sql_top('bm25', 10)}), p AS (SELECT b.query_id, b.doc, q.query, coalesce(title, '') AS t0, coalesce(abstract, '') AS a0, nullif({_NT('title')}, '') AS nt, x.* EXCLUDE (id, title, abstract), list_distinct(list_filter([CASE WHEN contains({_PROV}, 'arxiv') THEN 'arxiv' END, CASE WHEN contains({_PROV}, 'openalex') THEN 'openalex' END, CASE WHEN coalesce(source, '') <> '' THEN lower(source) END], lambda z: z IS NOT NULL)) AS src0 FROM best b JOIN papers x ON x.id = b.doc JOIN queries q ON q.query_id = b.query_id), tc AS (SELECT {_NT('title')} AS nt, count(*) AS tc FROM papers GROUP BY 1), f AS (SELECT p.*, CASE WHEN len(src0) = 0 THEN ['unknown'] ELSE src0 END AS src, CASE WHEN p.nt IS NULL THEN 1 ELSE coalesce(tc.tc, 1) END AS tc, CASE WHEN p.nt IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY query_id, p.nt) END AS qc FROM p LEFT JOIN tc ON tc.nt = p.nt) SELECT query_id, doc, {', '.join(f'round(({v})::DOUBLE, 6) AS {k}' for k, v in _TEXT_FEATURES.items())} FROM f",
    "regenerated_ranks": f"{BASE}, {LAB}, best AS (SELECT lower(trim(query_id)) AS query_id, doc, score, rank FROM ({sql_top('bm25', 50)})), n AS (SELECT *, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END AS normal FROM best WINDOW w AS (PARTITION BY query_id)) SELECT lab.query_id, lab.doc, coalesce(rank, 51) AS rank, round(coalesce(normal, 0), 6) AS normal FROM lab LEFT JOIN n USING (query_id, doc)",
    "pool_fallback": f"{BASE}, {CITED}, a AS (SELECT query_id, doc, score FROM ({sql_top('bm25', 5)}) WHERE right(query_id, 1) IN ('1', '3', '5', '7', '9')), b AS (SELECT query_id, doc, score FROM ({sql_top('cited', 5)}) WHERE query_id NOT IN (SELECT query_id FROM a)) SELECT query_id, doc, round(score, 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b)",
    "feature_matrix": f"SELECT id AS doc, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} IS NULL THEN {chr(39)}{c}{chr(39)} END' for c in _PC)}, 'absent'], lambda x: x IS NOT NULL), ',') AS missing, {_HEX(*_PC)} AS digest FROM papers",
    "feature_coverage": " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS rows, count({c}) AS there, sum((coalesce({c}, 0) <> 0)::INT) AS nonzero, round(count({c}) / count(*)::DOUBLE, 6) AS share FROM papers" for c in (*_PC, "influential_citation_count")),
    "feature_directions": f"{_W}, c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(corr({c}, reading), 0) AS r, {s} AS expected FROM lab" for c, s in (("cited", 1), ("recent", 1), ("long", -1), ("topic", 1))) + ") SELECT feature, round(r, 6) AS r, expected, r * expected <= -0.05 AS odd FROM c",
    "coefficient_signs": f"{_W} SELECT 'cited' AS feature, round(regr_slope(reading, cited), 6) AS coefficient, -1 AS expected, regr_slope(reading, cited) > 0 AS suspicious FROM lab",
    "refined_blends": f"{_W}, sc AS (SELECT *, {_n('cited')}, {_n('recent')}, {_n('long')} FROM lab WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc, {', '.join(f'round({v}, 6) AS {k}' for k, v in _REF.items())} FROM sc",
    "field_inventory": "SELECT 'ids' AS field, 'doi' AS item, count(doi) AS rows FROM sample_papers UNION ALL SELECT 'ids', 'url', count(url) FROM sample_papers UNION ALL SELECT 'categories', c, count(*) FROM (SELECT unnest(list_distinct(categories)) AS c FROM sample_papers) GROUP BY 2",
    "bucket_packets": f"{_W}, a AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY cited DESC, doc) AS r FROM lab WHERE gain IS NULL QUALIFY r <= 3), b AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY long DESC, doc) AS r FROM lab WHERE long > 0 AND (query_id, doc) NOT IN (SELECT (query_id, doc) FROM a) QUALIFY r <= 2), c AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY recent DESC, doc) AS r FROM lab WHERE (query_id, doc) NOT IN (SELECT (query_id, doc) FROM a UNION SELECT (query_id, doc) FROM b) QUALIFY r <= 1), u AS (SELECT *, 'cited' AS bucket, 0 AS s FROM a UNION ALL SELECT *, 'long', 1 FROM b UNION ALL SELECT *, 'recent', 2 FROM c) SELECT query_id, doc, bucket, row_number() OVER (PARTITION BY query_id ORDER BY s, r) AS place FROM u QUALIFY place <= 5",
    "boundary_packets": f"{_W}, {_WIDE}, x AS (SELECT wr.*, least(c, r, l) AS best, greatest(c, r, l) - least(c, r, l) AS gap, {sql_hits(_T, ['survey', 'review', 'overview'])} > 0 OR {sql_hits(_A, ['we survey', 'this survey'])} > 0 AS survey, {sql_hits(chr(40) + 'lower(coalesce(title, ' + chr(39) * 2 + ') || chr(10) || substr(coalesce(abstract, ' + chr(39) * 2 + '), 1, 500))' + chr(41), S.APPLICATION_TERMS)} > 0 AS app, len(regexp_extract_all(lower(coalesce(abstract, '')), '[\\p{{L}}\\p{{N}}_]+')) < 50 AS short FROM wr JOIN papers ON id = doc), y AS (SELECT *, list_filter([CASE WHEN query_id = 'manual_000000001' THEN 'topic_needs_more_labels' END, CASE WHEN query_id = 'manual_000000002' THEN 'validation_or_test_topic' END, CASE WHEN best BETWEEN 8 AND 35 THEN 'top10_top30_boundary_candidate' END, CASE WHEN best NOT BETWEEN 8 AND 35 AND best <= 30 THEN 'high_rank_unjudged_candidate' END, CASE WHEN gap >= 20 THEN 'ranker_disagreement_candidate' END, CASE WHEN app THEN 'application_overpromotion_candidate' END, CASE WHEN survey THEN 'generic_survey_candidate' END, CASE WHEN short THEN 'short_abstract_evidence_gap' END], lambda z: z IS NOT NULL) AS reasons FROM x) SELECT query_id, doc, CASE WHEN len(reasons) = 0 THEN 'boundary_case_candidate' ELSE array_to_string(reasons, ',') END AS reasons, CASE WHEN survey THEN 'generic_survey_check' WHEN app THEN 'application_overpromotion_check' WHEN gap >= 20 THEN 'hard_negative_check' WHEN best BETWEEN 8 AND 35 THEN 'partial_match_check' ELSE 'boundary_case_check' END AS focus, round((query_id = 'manual_000000001')::INT * 100 + (query_id = 'manual_000000002')::INT * 20 + CASE WHEN best BETWEEN 8 AND 35 THEN 25 WHEN best <= 30 THEN 15 ELSE 0 END + (gap >= 20)::INT * 20 + app::INT * 10 + survey::INT * 10 + short::INT * 5 - best * 0.01, 6)::DOUBLE AS score FROM y",
    "audit_packets": f"{_W}, e AS (SELECT l.query_id, l.doc, 'top of ' || method AS reason, rank, method || lpad(rank::VARCHAR, 3, '0') AS seen, CASE WHEN gain IS NOT NULL THEN 'judged' WHEN {_VAGUE} THEN 'vague' END AS out, CASE method WHEN 'cited' THEN 1 WHEN 'recent' THEN 2 ELSE 3 END AS p FROM lruns l JOIN papers ON id = doc WHERE rank <= 10), k AS (SELECT *, min(p) OVER (PARTITION BY query_id, doc) AS low FROM e WHERE out IS NULL QUALIFY row_number() OVER (PARTITION BY query_id, doc ORDER BY seen DESC) = 1), z AS (SELECT * FROM k ORDER BY low, rank, query_id, doc LIMIT 200) SELECT query_id, doc::VARCHAR AS doc, reason, rank FROM z UNION ALL SELECT 'excluded', out, '', count(*) FROM e WHERE out IS NOT NULL GROUP BY out",
    "topic_anchors": f"{_W}, x AS (SELECT *, CASE WHEN bucket = 2 THEN 'strong' WHEN negative THEN 'negative' END AS category FROM lab) SELECT query_id, category, doc FROM x WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, category ORDER BY cited DESC, doc) = 1",
    "patched_lists": f"{_W} SELECT query_id, rank AS place, CASE WHEN rank = 2 THEN doc + 1000000 ELSE doc END AS doc, rank = 2 AS replaced FROM lruns WHERE method = 'cited' AND rank <= 5",
    "evidence_packets": f"{_W}, r AS (SELECT l.query_id, l.doc, rank AS place, l.doc % 3 = 0 AS ft, {_VAGUE} AS vague, l.doc % 6 AS methods, sum((rank <= 4 AND l.doc % 3 = 0)::INT) OVER (PARTITION BY l.query_id) >= 2 AS enough FROM lruns l JOIN papers ON id = doc WHERE method = 'cited'), w AS (SELECT *, CASE WHEN ft THEN 100.0 ELSE 25.0 END + least(methods, 5) * 12 + greatest(25 - place, 0) + greatest(21 - place, 0) AS s FROM r WHERE NOT enough AND place <= 8 AND (ft OR NOT vague)), v AS (SELECT *, least(count(*) OVER (PARTITION BY query_id), 4) AS n, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, place) AS a, row_number() OVER (PARTITION BY query_id ORDER BY place) AS b FROM w) SELECT query_id, doc, place, 'enough full text' AS why FROM r WHERE enough AND place <= 4 UNION ALL SELECT query_id, doc, place, 'widened' FROM v WHERE CASE WHEN n < 2 THEN b ELSE a END <= 4",
    "learning_packets": f"{_W}, {_WIDE}, s AS (SELECT query_id, doc, round(0.1 * (greatest(c, r, l) - least(c, r, l)) + 2.0 * CASE WHEN c BETWEEN 8 AND 12 THEN 1 ELSE 0 END, 9)::DOUBLE AS score FROM wr) SELECT query_id, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS place FROM s QUALIFY place <= 3",
    # k leaves no choice out: of topics alike in n and in which buckets they have, a later one than the fourth gives way to an earlier one that is free.
    "balanced_topics": f"{_W}, tp AS (SELECT query_id, sum(negative::INT) AS n, sum((bucket = 0)::INT) AS b0, sum((bucket = 1)::INT) AS b1, sum((bucket = 2)::INT) AS b2 FROM lab GROUP BY 1), k AS (SELECT * FROM tp QUALIFY row_number() OVER (PARTITION BY n, b0 > 0, b1 > 0, b2 > 0 ORDER BY query_id) <= 4), s AS (SELECT a.query_id AS x, b.query_id AS y, a.n + b.n AS n, abs(a.n + b.n - 5) + 100000 * ((least(a.b0 + b.b0, a.b1 + b.b1, a.b2 + b.b2) = 0)::INT + (a.n + b.n = 0)::INT) AS p FROM k a JOIN k b ON a.query_id < b.query_id), best AS (SELECT v.x AS v1, v.y AS v2, t.x AS t1, t.y AS t2 FROM s v JOIN s t ON v.x <> t.x AND v.x <> t.y AND v.y <> t.x AND v.y <> t.y ORDER BY v.p + t.p + 1.5 * abs(v.n - t.n), v1, v2, t1, t2 LIMIT 1) SELECT CASE WHEN query_id IN (v1, v2) THEN 'val' WHEN query_id IN (t1, t2) THEN 'test' ELSE 'train' END AS split, query_id FROM tp LEFT JOIN best ON true",
    "identity_verdicts": f"WITH rows AS (SELECT id + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS id, CASE WHEN id % 3 = 0 THEN title || '!' ELSE title END AS title, year FROM papers), o AS (SELECT DISTINCT {_NT('title')} AS nt, year FROM papers WHERE {_NT('title')} <> ''), m AS (SELECT r.*, p.id AS cid, p.title AS ct, p.year AS cy, o.nt IS NOT NULL AS moved FROM rows r LEFT JOIN papers p ON p.id = r.id LEFT JOIN o ON o.nt = {_NT('r.title')} AND o.year = r.year) SELECT CASE WHEN cid IS NOT NULL AND coalesce(title = ct, false) THEN 'same' WHEN cid IS NOT NULL AND coalesce({_NT('title')} = {_NT('ct')}, false) AND year IS NOT DISTINCT FROM cy THEN 'same but for spelling' WHEN moved THEN 'under another id' WHEN cid IS NULL THEN 'unknown id' ELSE 'another title' END AS verdict, count(*) AS n FROM m GROUP BY 1",
    "alignment_verdict": "WITH x AS (SELECT id, row_number() OVER (PARTITION BY year ORDER BY id) AS number FROM papers) SELECT count(*) AS rows, sum((number = id)::INT) AS aligned, count(*) > 0 AND count(*) = sum((number = id)::INT) AS safe FROM x",
    "source_verdicts": "WITH p AS (SELECT coalesce(source, 'unknown') AS source, count(*) AS n, count(doi) / count(*)::DOUBLE AS d, count(DISTINCT id) AS ids FROM papers GROUP BY 1) SELECT source, concat_ws(',', CASE WHEN n < 100 THEN 'too few' END, CASE WHEN d < 0.5 THEN 'few dois' END, CASE WHEN ids <> n THEN 'repeated ids' END, CASE WHEN source = 'unknown' THEN 'unknown' END) AS reasons, n >= 100 AND d >= 0.5 AND ids = n AND source <> 'unknown' AS accepted FROM p",
}
