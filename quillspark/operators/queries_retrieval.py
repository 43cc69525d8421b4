"""Retrieval queries over papers and manual queries, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.signals import (
    BACKGROUND_TERMS,
    BEGINNER_TERMS,
    BROAD_QUERIES,
    DOMAIN_QUERIES,
    HYBRID_WEIGHTS,
    METHOD_TERMS,
    NARROW_TERMS,
    TECHNICAL_TERMS,
)
from quillspark.operators import retrieval as R
from quillspark.runtime import load, spread

NOW = 2026
TOP = 10


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Papers as retrieval documents: doc, text and the metadata of the signals."""
    p = spread(load(spark, d, "papers"))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("abstract", F.lit("")))
    keep = ["title", "abstract", "venue", "categories", "year", "citation_count", "references_count", "influential_citation_count", "abstract_word_count"]
    return p.select(F.col("id").alias("doc"), text.alias("text"), *keep)


def query_table(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "manual_queries").where(F.trim("query") != "").select("query_id", "query")


def _out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc", F.round("score", 6).alias("score"))


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    return _out(R.bm25_top(documents(spark, d).select("doc", "text"), query_table(spark, d), TOP))


def bm25_all(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each query scores, and the sum of its scores."""
    totals = R.bm25_totals(documents(spark, d).select("doc", "text"), query_table(spark, d))
    return totals.select("query_id", "hits", F.round("total", 4).alias("total"))


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc", "text")
    return R.bm25_idf(R.postings(docs), docs).select("term", "df", F.round("idf", 6).alias("idf"))


def corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    return R.corpus_statistics(documents(spark, d).select("doc", "text")).select("n_docs", F.round("mean_length", 6).alias("mean_length"))


def tfidf_batch(spark: SparkSession, d: str) -> DataFrame:
    return _out(R.tfidf_top(documents(spark, d).select("doc", "text"), query_table(spark, d), TOP))


def citation_recency_batch(spark: SparkSession, d: str) -> DataFrame:
    return _out(R.citation_recency_top(documents(spark, d).select("doc", "text", "year", "citation_count"), query_table(spark, d), TOP))


def more_like_this(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc", "text")
    return _out(R.more_like(docs, docs.where("doc % 100 = 0").select("doc"), 5))


def _usable(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "paper_vectors").where("size(embedding) = 128 and exists(embedding, x -> x <> 0)")
    return v.groupBy(F.col("document_id").alias("doc")).agg(F.min("embedding").alias("embedding"))


def dense_neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = _usable(spark, d)
    q = v.where("doc % 100 = 0").select(F.col("doc").alias("query_id"), "embedding")
    return _out(R.dense_search(v, q, TOP))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Length of each usable vector before and after scaling."""
    v = _usable(spark, d)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = R.unit_vectors(v.withColumn("before", norm), "embedding")
    after = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return unit.select("doc", F.round("before", 6).alias("before"), F.round(after, 6).alias("after"))


def index_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "paper_vectors").agg(F.count("document_id").alias("n"), F.countDistinct("document_id").alias("distinct_ids"), F.min("document_id").alias("least"), F.max("document_id").alias("most"))


def hybrid_batch(spark: SparkSession, d: str) -> DataFrame:
    return _out(R.hybrid(documents(spark, d), query_table(spark, d), TOP, now=NOW))


def pool_ranks(spark: SparkSession, d: str) -> DataFrame:
    docs, q = documents(spark, d), query_table(spark, d)
    runs = {"bm25": R.bm25_top(docs.select("doc", "text"), q, 20), "tfidf": R.tfidf_top(docs.select("doc", "text"), q, 20), "cited": R.citation_recency_top(docs.select("doc", "text", "year", "citation_count"), q, 20)}
    return R.best_ranks(runs, 20).select("query_id", "doc", "methods", "best_rank", F.round("mean_rank", 6).alias("mean_rank"))


# --- the same in SQL ---------------------------------------------------------------------------------------------------


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def sql_hits(text: str, terms: list[str]) -> str:
    return f"len(list_filter({sql_list(terms)}, lambda x: contains({text}, x)))"


DOCS = """docs AS (SELECT id AS doc, coalesce(title, '') || chr(10) || chr(10) || coalesce(abstract, '') AS text, title, abstract, venue, categories, year, citation_count,
  references_count, influential_citation_count, abstract_word_count FROM papers)"""
QUERIES_SQL = "queries AS (SELECT query_id, query FROM manual_queries WHERE trim(query) <> '')"
TOKENS = """tokens AS (SELECT doc, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM docs),
posts AS (SELECT term, doc, count(*) AS tf, any_value(length) AS length FROM (SELECT doc, len(t) AS length, unnest(t) AS term FROM tokens) GROUP BY term, doc),
stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_length FROM tokens),
idf AS (SELECT term, count(*) AS df, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts, stats GROUP BY term, n_docs)"""
QTERMS = "qterms AS (SELECT query_id, lower(term) AS term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(query, '[A-Za-z0-9_]+')) AS term FROM queries) GROUP BY 1, 2)"
BM25 = """bm25 AS (SELECT q.query_id, p.doc, round(sum(q.times * i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.length / s.mean_length))), 9) AS score
  FROM qterms q JOIN posts p USING (term) JOIN idf i USING (term), stats s GROUP BY 1, 2)"""
_WORDS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains(" + sql_list(R.STOP_WORDS) + ", x))"


def _grams(table: str, key: str, text: str, name: str) -> str:
    w = _WORDS.format(text)
    return f"""{name}_w AS (SELECT {key}, {w} AS t FROM {table}),
{name} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(t) AS term FROM {name}_w UNION ALL
  SELECT {key}, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) FROM {name}_w) GROUP BY 1, 2)"""


TFIDF = (
    _grams("docs", "doc", "text", "dterms")
    + """,
tidf AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM dterms, (SELECT count(*) AS n FROM docs) GROUP BY term, n),
dvec AS (SELECT doc, term, tf * idf AS x, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY doc)) AS norm FROM dterms JOIN tidf USING (term)),
"""
    + _grams("queries", "query_id", "query", "gterms")
    + """,
qvec AS (SELECT query_id, term, tf * idf AS x, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY query_id)) AS norm FROM gterms JOIN tidf USING (term)),
tfidf AS (SELECT q.query_id, v.doc, round(sum(v.x / v.norm * q.x / q.norm), 9) AS score FROM qvec q JOIN dvec v USING (term) GROUP BY 1, 2)"""
)
CITED = """cited AS (SELECT b.query_id, b.doc, b.score + 0.1 * ln(1 + greatest(coalesce(citation_count, 0), 0)) + 0.2 * CASE WHEN year IS NULL THEN 0 WHEN hi = lo THEN 1 ELSE (year - lo) / (hi - lo)::DOUBLE END AS score
  FROM bm25 b JOIN docs USING (doc), (SELECT min(year) AS lo, max(year) AS hi FROM docs))"""
BASE = f"WITH {DOCS}, {QUERIES_SQL}, {TOKENS}, {QTERMS}, {BM25}"


def sql_top(run: str, k: int) -> str:
    return f"SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM {run} QUALIFY rank <= {k}"


def _final(run: str, k: int = TOP) -> str:
    return f"SELECT query_id, doc, round(score, 6) AS score FROM ({sql_top(run, k)})"


_TEXT = "lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(venue, '') || ' ' || coalesce(array_to_string(categories, '; '), ''))"
_SHORT = "lower(coalesce(title, '') || ' ' || coalesce(abstract, ''))"
_WC = "coalesce(CASE WHEN abstract_word_count <> 0 THEN abstract_word_count END, len(regexp_extract_all(lower(coalesce(abstract, '')), '[\\p{L}\\p{N}_]+')), 0)"
SIGNALS = f"""facts AS (SELECT *, {_TEXT} AS txt, {_SHORT} AS brief, {_WC} AS words, len(regexp_extract_all({_SHORT}, '[\\p{{L}}\\p{{N}}_]+')) AS brief_words FROM docs),
hard AS (SELECT *, CASE WHEN brief_words = 0 THEN 0 ELSE {sql_hits('brief', TECHNICAL_TERMS)} / brief_words::DOUBLE END AS density FROM facts),
signals AS (SELECT *, round(least(greatest(0.35
    + CASE WHEN {sql_hits('brief', BEGINNER_TERMS)} > 0 THEN -0.24 ELSE 0 END
    + CASE WHEN words >= 350 THEN 0.18 WHEN words >= 220 THEN 0.10 WHEN words <= 90 THEN -0.08 ELSE 0 END
    + CASE WHEN density >= 0.025 THEN 0.24 WHEN density >= 0.012 THEN 0.12 ELSE 0 END
    + CASE WHEN coalesce(references_count, 0) >= 80 THEN 0.10 ELSE 0 END
    + CASE WHEN year >= {NOW} - 2 AND coalesce(citation_count, 0) < 50 THEN 0.12 ELSE 0 END
    + CASE WHEN coalesce(citation_count, 0) >= 1000 THEN -0.08 WHEN coalesce(citation_count, 0) >= 200 THEN -0.04 ELSE 0 END, 0.0::DOUBLE), 1.0::DOUBLE)::DOUBLE, 3) AS difficulty,
  least(ln(1 + greatest(coalesce(citation_count, 0), 0)) / 8, 1) AS citation, least(ln(1 + greatest(coalesce(influential_citation_count, 0), 0)) / 6, 1) AS influence,
  CASE WHEN year IS NULL THEN 0 WHEN {NOW} - year <= 1 THEN 1 WHEN {NOW} - year <= 3 THEN 0.82 WHEN {NOW} - year <= 5 THEN 0.35 WHEN {NOW} - year <= 8 THEN 0.18 ELSE 0.05 END AS recency,
  least({sql_hits('txt', BACKGROUND_TERMS)} / 2.0, 1) AS background, least({sql_hits('txt', METHOD_TERMS)} / 2.0, 1) AS method, least({sql_hits('txt', NARROW_TERMS)} / 2.0, 1) AS narrow FROM hard)"""
_Q = "trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g'))"
QSIGNALS = f"""qsignals AS (SELECT query_id, CASE WHEN list_contains({sql_list(BROAD_QUERIES)}, {_Q}) THEN 1.0 WHEN len(string_split({_Q}, ' ')) <= 3 AND {sql_hits(_Q, BROAD_QUERIES)} > 0 THEN 0.85 ELSE 0 END AS generic,
  {sql_hits(_Q, DOMAIN_QUERIES)} > 0 AS domain FROM queries)"""
_W = HYBRID_WEIGHTS
HYBRID = f"""pool AS (SELECT query_id, doc, 'bm25' AS m, score / max(score) OVER (PARTITION BY query_id) AS x FROM ({sql_top('bm25', 80)}) UNION ALL
  SELECT query_id, doc, 'tfidf', score / max(score) OVER (PARTITION BY query_id) FROM ({sql_top('tfidf', 80)})),
wide AS (SELECT query_id, doc, coalesce(max(CASE WHEN m = 'bm25' THEN x END), 0) AS bm25, coalesce(max(CASE WHEN m = 'tfidf' THEN x END), 0) AS tfidf FROM pool GROUP BY 1, 2),
mixed AS (SELECT w.query_id, w.doc, s.*, q.*, CASE WHEN 0.48 * bm25 + 0.22 * tfidf = 0 THEN greatest(bm25, tfidf, 0) ELSE 0.48 * bm25 + 0.22 * tfidf END AS relevance FROM wide w JOIN signals s USING (doc) JOIN qsignals q USING (query_id)),
hybrid AS (SELECT query_id, doc, {_W['relevance']} * relevance + {_W['citation']} * citation + {_W['influence']} * influence + {_W['recency']} * recency
  + {_W['fit']} * CASE WHEN difficulty < 0.34 THEN 1.0 WHEN difficulty < 0.67 THEN 0.72 ELSE 0.28 END + {_W['background']} * background + {_W['method']} * method
  - CASE WHEN narrow > 0 AND NOT domain AND greatest(citation, influence) < 0.78 THEN 0.22 * narrow * generic ELSE 0 END AS score FROM mixed),
hybrid_hits AS (SELECT * FROM hybrid WHERE score > 0)"""
_USABLE = "usable AS (SELECT document_id AS doc, min(embedding)::DOUBLE[] AS e FROM paper_vectors WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)"

QUERIES = {
    f.__name__: f
    for f in (bm25_batch, bm25_all, term_statistics, corpus_statistics, tfidf_batch, citation_recency_batch, more_like_this, dense_neighbours, vector_norms, index_diagnostics, hybrid_batch, pool_ranks)
}
SQL = {
    "bm25_batch": f"{BASE} {_final('bm25')}",
    "bm25_all": f"{BASE} SELECT query_id, count(*) AS hits, round(sum(score), 4) AS total FROM bm25 GROUP BY 1",
    "term_statistics": f"WITH {DOCS}, {TOKENS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "corpus_statistics": f"WITH {DOCS}, {TOKENS} SELECT n_docs, round(mean_length, 6) AS mean_length FROM stats",
    "tfidf_batch": f"WITH {DOCS}, {QUERIES_SQL}, {TFIDF} {_final('tfidf')}",
    "citation_recency_batch": f"{BASE}, {CITED} {_final('cited')}",
    "more_like_this": f"WITH {DOCS}, queries AS (SELECT doc AS query_id, text AS query FROM docs WHERE doc % 100 = 0), {TOKENS}, {QTERMS}, {BM25}, others AS (SELECT * FROM bm25 WHERE doc <> query_id) {_final('others', 5)}",
    "dense_neighbours": f"WITH {_USABLE}, sims AS (SELECT q.doc AS query_id, v.doc, list_cosine_similarity(q.e, v.e) AS score FROM usable q JOIN usable v ON v.doc <> q.doc WHERE q.doc % 100 = 0) {_final('sims')}",
    "vector_norms": f"WITH {_USABLE} SELECT doc, round(sqrt(list_inner_product(e, e)), 6) AS before, round(1.0::DOUBLE, 6) AS after FROM usable",
    "index_diagnostics": "SELECT count(document_id) AS n, count(DISTINCT document_id) AS distinct_ids, min(document_id) AS least, max(document_id) AS most FROM paper_vectors",
    "hybrid_batch": f"{BASE}, {TFIDF}, {SIGNALS}, {QSIGNALS}, {HYBRID} {_final('hybrid_hits')}",
    "pool_ranks": f"""{BASE}, {TFIDF}, {CITED}, long AS (SELECT 'bm25' AS m, * FROM ({sql_top('bm25', 20)}) UNION ALL SELECT 'tfidf', * FROM ({sql_top('tfidf', 20)}) UNION ALL SELECT 'cited', * FROM ({sql_top('cited', 20)}))
SELECT query_id, doc, string_agg(m, ',' ORDER BY CASE m WHEN 'bm25' THEN 0 WHEN 'tfidf' THEN 1 ELSE 2 END) AS methods, min(rank) AS best_rank, round(avg(rank), 6) AS mean_rank FROM long GROUP BY 1, 2""",
}
