"""Queries of flags, labels, pairs, explanations and excerpts, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import labels as L
from quillspark.operators import labelsets as S
from quillspark.operators import registry as M
from quillspark.operators.queries_evaluation import JUDGED, judged
from quillspark.functions.signals import TYPE_TERMS
from quillspark.operators.queries_retrieval import _USABLE, BASE, BM25, CITED, DOCS, HYBRID, QSIGNALS, QTERMS, SIGNALS, TFIDF, TOKENS, documents, query_table, sql_hits, sql_list, sql_top
from quillspark.runtime import load, spread

TITLE_TERMS = ["learning", "graph", "neural", "model", "models", "network"]
FALSE_FRIENDS = ["traffic", "mesh", "clinical", "survey", "random walk"]
ROLES = ["background", "foundational", "core_methods", "recent_frontier", "evaluation_benchmark", "application"]


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Judged pairs with the fields of a full label: reading and topic scores, bucket, roles, duplicate status and levels. The
    test tables have gains and negatives only; the other fields are set by rules from the ids."""
    doc, reading = F.col("doc"), F.coalesce("gain", F.lit(0.0))
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    return judged(spark, d).select(
        "*", reading.alias("reading"), F.least(0.5 * reading + F.when(doc % 3 == 0, 0.5).otherwise(0.1), F.lit(1.0)).alias("topic"),
        F.when(reading >= 0.66, 2).when(reading >= 0.33, 1).otherwise(0).alias("bucket"), pick(ROLES, doc).alias("role"), pick(ROLES, F.floor(doc / 6)).alias("second_role"),
        pick(["none", "uncertain", "near_duplicate", "exact_duplicate"], doc).alias("status"), ((doc % 5) / 4.0).alias("beginner"), ((doc % 7) / 6.0).alias("intermediate"), ((doc % 3) / 2.0).alias("advanced"),
    )


def labelled_runs(spark: SparkSession, d: str) -> DataFrame:
    """(method, score, rank) of three plain methods for every labelled pair."""
    j = labelled(spark, d)
    long = j.select("*", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in ("cited", "recent", "long")])))
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "doc")))


def paper_flags(spark: SparkSession, d: str) -> DataFrame:
    """Survey, vague abstract, PDF address, title words, role reasons, false friends and provenance of every paper."""
    p = load(spark, d, "papers")
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    friends = F.array(*[F.lit(t) for t in FALSE_FRIENDS])
    return p.select(
        "id", L.generic_survey(F.col("title"), F.col("abstract")).alias("survey"), L.vague_abstract(F.col("abstract")).alias("vague"), L.allowed_pdf(F.col("url")).alias("pdf"), L.shares_token(F.col("title"), TITLE_TERMS).alias("on_topic"),
        F.array_join(L.role_reasons(F.col("title"), F.col("abstract")), ",").alias("reasons"), F.array_join(L.lexicon_hits(text, friends), ",").alias("friends"),
        F.array_join(L.provenance(*[F.col(c) for c in ("source", "external_id", "source_url", "url", "doi")]), ",").alias("provenance"),
    )


def coverage_guesses(spark: SparkSession, d: str) -> DataFrame:
    """Likely use of the best lexical candidates of every query, by word overlap with the title, year and citations."""
    from quillspark.functions.text import overlap_shares
    from quillspark.operators.retrieval import bm25_top

    best = bm25_top(documents(spark, d).select("doc", "text"), query_table(spark, d), 10)
    c = best.join(load(spark, d, "papers").select(F.col("id").alias("doc"), "title", "year", "citation_count"), "doc").join(query_table(spark, d), "query_id")
    c = c.withColumn("overlap", overlap_shares(F.col("query"), F.col("title"))["overlap"])
    reasons = F.when(F.col("doc") % 11 == 0, F.array(F.lit("random_weak_negative"))).when(F.col("doc") % 13 == 0, F.array(F.lit("canonical_foundational_seed"))).otherwise(F.array().cast("array<string>"))
    guess = L.coverage_guess(F.col("title"), F.col("year"), F.col("citation_count"), F.col("overlap"), reasons)
    return c.groupBy("query_id", guess.alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def label_flags(spark: SparkSession, d: str) -> DataFrame:
    """Positive and hidden-positive flags and the best difficulty level under the three tie rules."""
    levels = {k: F.col(k) for k in ("beginner", "intermediate", "advanced")}
    return labelled(spark, d).select(
        "query_id", "doc", L.positive(F.col("reading"), F.col("topic")).alias("positive"), L.hidden_positive(F.col("reading"), F.col("topic")).alias("hidden"),
        L.best_levels(levels, "+").alias("level"), L.best_levels(levels, ",").alias("levels"), L.best_level(levels).alias("one_level"),
    )


def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The first 600 preference pairs of every query and their kinds."""
    return S.preference_pairs(labelled(spark, d), 600).groupBy("query_id", "kind").agg(F.count(F.lit(1)).alias("pairs"), F.sum("preferred").alias("preferred"), F.sum("rejected").alias("rejected"))


def explained_papers(spark: SparkSession, d: str) -> DataFrame:
    """Reasons, neighbours in the reading order and learned adjustment for signals of every paper."""
    from quillspark.functions import signals as G

    s = G.document_signals(documents(spark, d), 2026)
    tags = G.paper_types(F.col("title"), F.col("abstract"), F.col("venue"), F.col("citation_count"), F.col("year"), 2026)
    fit = G.difficulty_fit(F.col("difficulty"), "basic_ml")
    why = L.explanation_signals(F.col("background"), 8.0 * F.col("citation"), F.col("recency"), fit, F.col("background"), F.col("method"), F.lit(0.0), tags)
    section = F.element_at(F.array(*[F.lit(x) for x in L.SECTION_NAMES]), (F.col("doc") % 4 + 1).cast("int"))
    return s.select("doc", F.array_join(why, "; ").alias("why"), F.array_join(L.read_before(section), ",").alias("before"), F.array_join(L.read_after(section), ",").alias("after"), F.round(L.learned_adjustment(F.col("citation"), F.when(F.col("doc") % 2 == 0, F.col("method"))), 6).alias("adjusted"))


def document_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts of every document: at a heading word, at a keyword, the ending, and what stands under headings."""
    t = spread(load(spark, d, "documents").select("doc_id", "text")).withColumn("flat", L.flat(F.regexp_replace("text", "[^ -~\n]+", "?")))
    return t.select(
        "doc_id", L.excerpt_at(F.col("flat"), ["introduction", "background"], 40).alias("intro"), L.excerpt_at(F.col("flat"), ["propose", "method", "model", "approach"], 40, 10).alias("keyword"),
        F.right(F.col("flat"), F.lit(30)).alias("ending"), F.size(L.heading_lines(F.col("text"))).alias("headings"), F.length(L.named_section(F.col("text"), ["methods", "method"])).alias("method_length"),
    )


def best_windows(spark: SparkSession, d: str) -> DataFrame:
    """Of every document the window of 60 characters with most words of interest."""
    words = F.array(*[F.lit(x) for x in ("model", "data", "method")])
    t = spread(load(spark, d, "documents").select("doc_id", "text"))
    return t.select("doc_id", L.best_window(L.flat(F.regexp_replace("text", "[^ -~\n]+", "?")), words, 60).alias("w")).select("doc_id", F.col("w.at").alias("at"), F.col("w.hits").alias("hits"))


def topic_matches(spark: SparkSession, d: str) -> DataFrame:
    topics = F.array(*[F.lit(x) for x in ("graph neural network", "retrieval of papers", "ab")])
    p = load(spark, d, "papers")
    return p.select("id", F.round(L.topic_match(F.concat_ws(" ", "title", "abstract"), topics), 6).alias("match"))


def identifier_scans(spark: SparkSession, d: str) -> DataFrame:
    """Papers whose id has a catalogue's prefix in any case, those whose references' text names a catalogue and that are not
    among them, and how many are in both sets."""
    s = load(spark, d, "sample_papers")
    named = s.where(F.col("external_id").ilike("openalex:%")).select("external_id").distinct()
    told = s.where(F.to_json(F.struct("reference_ids")).like("%openalex%")).select("external_id").distinct()
    rest = told.join(named, "external_id", "left_anti")
    both = told.join(named, "external_id")
    count = lambda df, name: df.agg(F.countDistinct("external_id").alias("n")).select(F.lit(name).alias("scan"), "n")
    return count(named, "prefix").unionByName(count(told, "text")).unionByName(count(rest, "text only")).unionByName(count(both, "both"))


def method_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return M.methods(spark)


def recommended(spark: SparkSession, d: str) -> DataFrame:
    """Results of two methods asked for by name."""
    docs, q = documents(spark, d), query_table(spark, d)
    runs = [M.recommend(m, docs, q, 5) for m in (" BM25 ", "citation_recency")]
    return reduce(DataFrame.unionByName, runs).select("method", "query_id", "doc", F.round("score", 6).alias("score"))


def hybrid_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search by example: papers with an id divisible by 100 that have a title and a usable vector are the queries,
    with the dense run as a third source."""
    from quillspark.operators import retrieval as R
    from quillspark.operators.queries_retrieval import _usable

    docs, v = documents(spark, d), _usable(spark, d)
    q = docs.where("doc % 100 = 0 and trim(title) <> ''").join(v, "doc").select(F.col("doc").alias("query_id"), F.col("title").alias("query"), "embedding")
    dense = R.dense_search(v, q.select("query_id", "embedding"), 80)
    return R.hybrid(docs, q.select("query_id", "query"), 10, dense=dense).select("query_id", "doc", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (paper_flags, coverage_guesses, label_flags, preference_pairs, explained_papers, document_excerpts, best_windows, topic_matches, identifier_scans, method_catalogue, recommended, hybrid_with_vectors)}

_pick = lambda names, n: f"{sql_list(names)}[({n}) % {len(names)} + 1]"
LAB = f"""{JUDGED}, lab AS (SELECT *, coalesce(gain, 0.0) AS reading, least(0.5 * coalesce(gain, 0.0) + CASE WHEN doc % 3 = 0 THEN 0.5 ELSE 0.1 END, 1.0)::DOUBLE AS topic,
  CASE WHEN coalesce(gain, 0.0) >= 0.66 THEN 2 WHEN coalesce(gain, 0.0) >= 0.33 THEN 1 ELSE 0 END AS bucket, {_pick(ROLES, 'doc')} AS role, {_pick(ROLES, 'doc // 6')} AS second_role,
  {_pick(['none', 'uncertain', 'near_duplicate', 'exact_duplicate'], 'doc')} AS status, (doc % 5) / 4.0::DOUBLE AS beginner, (doc % 7) / 6.0::DOUBLE AS intermediate, (doc % 3) / 2.0::DOUBLE AS advanced FROM judged),
lruns AS (SELECT lab.*, r.method, r.score, row_number() OVER (PARTITION BY r.method, lab.query_id ORDER BY r.score DESC, lab.doc) AS rank FROM lab JOIN runs r ON r.query_id = lab.query_id AND r.doc = lab.doc)"""
_T, _A = "lower(coalesce(title, ''))", "lower(coalesce(abstract, ''))"
_TA = f"({_T} || ' ' || {_A})"
_ABS = "lower(trim(regexp_replace(coalesce(abstract, ''), '\\s+', ' ', 'g')))"
_HOST, _PATH = "lower(regexp_extract(url, '^https://([^/?#]+)', 1))", "lower(regexp_extract(url, '^https://[^/?#]+([^?#]*)', 1))"
_PV = "lower(concat_ws(' ', coalesce(source, ''), coalesce(external_id, ''), coalesce(source_url, ''), coalesce(url, ''), coalesce(doi, '')))"
_LEVEL = "CASE WHEN greatest(beginner, intermediate, advanced) <= 0 THEN 'none' ELSE array_to_string(list_filter([CASE WHEN beginner = greatest(beginner, intermediate, advanced) THEN 'beginner' END, CASE WHEN intermediate = greatest(beginner, intermediate, advanced) THEN 'intermediate' END, CASE WHEN advanced = greatest(beginner, intermediate, advanced) THEN 'advanced' END], lambda x: x IS NOT NULL), '{0}') END"
_WORDS3 = "list_distinct(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[a-z0-9]{3,}'))"
_HEAD = f"{{0}} <> '' AND length({{0}}) <= 120 AND (list_contains({sql_list(L.HEADINGS)}, lower({{0}})) OR regexp_matches({{0}}, '^[0-9]+([.][0-9]+)*[.]?\\s+[A-Z][A-Za-z0-9 ,:;()/-]{{{{2,}}}}$'))"
_TAG_SQL = [f"CASE WHEN {sql_hits('tt', terms)} > 0{' OR coalesce(citation_count, 0) >= 1000' if tag == 'foundation' else ''} THEN '{tag}' END" for tag, terms in TYPE_TERMS.items()] + ["CASE WHEN year >= 2023 THEN 'frontier' END"]


def _at(names: list[str], most: int, before: int) -> str:
    places = ", ".join(f"CASE WHEN regexp_matches(low, '\\b{n}\\b') THEN length(regexp_extract(low, '^(.*?)\\b{n}\\b', 1)) + 1 END" for n in names)
    return f"CASE WHEN coalesce({places}) IS NOT NULL THEN substr(flat, greatest(coalesce({places}) - {before}, 1), {most}) END"


_DENSE_HYBRID = (
    HYBRID.replace("SELECT query_id, doc, 'tfidf'", f"SELECT query_id, doc, 'dense', CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN greatest(score, 0) / max(score) OVER (PARTITION BY query_id) ELSE 0 END FROM ({sql_top('sims', 80)}) UNION ALL SELECT query_id, doc, 'tfidf'")
    .replace("AS tfidf FROM pool", "AS tfidf, coalesce(max(CASE WHEN m = 'dense' THEN x END), 0) AS dense FROM pool")
    .replace("CASE WHEN 0.48 * bm25 + 0.22 * tfidf = 0 THEN greatest(bm25, tfidf, 0) ELSE 0.48 * bm25 + 0.22 * tfidf END", "CASE WHEN 0.48 * bm25 + 0.22 * tfidf + 0.3 * dense = 0 THEN greatest(bm25, tfidf, dense, 0) ELSE 0.48 * bm25 + 0.22 * tfidf + 0.3 * dense END")
)
SQL = {
    "paper_flags": f"SELECT id, {sql_hits(_T, ['survey', 'review', 'overview'])} > 0 OR {sql_hits(_A, ['we survey', 'this survey'])} > 0 AS survey, length({_ABS}) < 50 OR list_contains({sql_list(L.VAGUE)}, {_ABS}) AS vague, coalesce({_HOST} <> '' AND CASE WHEN ends_with({_HOST}, 'arxiv.org') THEN starts_with({_PATH}, '/pdf/') WHEN {_HOST} = 'openreview.net' AND {_PATH} = '/pdf' THEN true ELSE ends_with({_PATH}, '.pdf') END, false) AS pdf, len(list_intersect(regexp_extract_all({_T}, '[a-z0-9]+'), {sql_list(TITLE_TERMS)})) > 0 AS on_topic, array_to_string(list_filter([{', '.join(f'CASE WHEN {sql_hits(_TA, t)} > 0 THEN {chr(39)}{r}{chr(39)} END' for r, t in L.ROLE_REASONS.items())}], lambda x: x IS NOT NULL), ',') AS reasons, array_to_string(list_filter({sql_list(FALSE_FRIENDS)}, lambda x: contains({_TA}, x)), ',') AS friends, CASE WHEN contains({_PV}, 'arxiv') OR contains({_PV}, 'openalex') OR coalesce(source, '') <> '' THEN concat_ws(',', CASE WHEN contains({_PV}, 'arxiv') THEN 'arxiv' END, CASE WHEN contains({_PV}, 'openalex') THEN 'openalex' END, CASE WHEN source <> '' AND lower(source) NOT IN ('arxiv', 'openalex') THEN lower(source) END) ELSE 'unknown' END AS provenance FROM papers",
    "coverage_guesses": f"{BASE}, best AS ({sql_top('bm25', 10)}), c AS (SELECT b.query_id, b.doc, title, year, coalesce(citation_count, 0) AS cites, len(list_intersect(list_distinct(regexp_extract_all(lower(q.query), '[a-z0-9]+')), list_distinct(regexp_extract_all({_T}, '[a-z0-9]+')))) AS o FROM best b JOIN docs USING (doc) JOIN queries q ON q.query_id = b.query_id), g AS (SELECT query_id, CASE WHEN doc % 11 = 0 THEN 'likely random/irrelevant negative' WHEN doc % 13 = 0 THEN 'likely core/foundational positive' WHEN {sql_hits(_T, ['survey', 'taxonomy', 'overview', 'benchmark', 'evaluation'])} > 0 AND o >= 1 THEN 'likely relevant survey/background' WHEN cites >= 1000 AND o >= 1 THEN 'likely core/foundational positive' WHEN year >= 2022 AND o >= 2 THEN 'likely recent frontier/application' WHEN o >= 3 AND cites >= 100 THEN 'likely core/foundational positive' WHEN o >= 2 AND year >= 2018 THEN 'likely recent frontier/application' WHEN o >= 2 THEN 'likely relevant survey/background' ELSE 'likely hard negative' END AS guess FROM c) SELECT query_id, guess, count(*) AS n FROM g GROUP BY 1, 2",
    "label_flags": f"WITH {LAB} SELECT query_id, doc, reading >= 0.5 AND topic >= 0.5 AS positive, reading >= 0.75 AND topic >= 0.5 AS hidden, {_LEVEL.format('+')} AS level, {_LEVEL.format(',')} AS levels, CASE WHEN greatest(beginner, intermediate, advanced) <= 0 THEN 'unknown' WHEN intermediate = greatest(beginner, intermediate, advanced) THEN 'intermediate' WHEN beginner = greatest(beginner, intermediate, advanced) THEN 'beginner' ELSE 'advanced' END AS one_level FROM lab",
    "preference_pairs": f"WITH {LAB}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bucket DESC, reading DESC, doc) AS r FROM lab), p AS (SELECT a.query_id, a.doc AS preferred, b.doc AS rejected, CASE WHEN b.negative THEN 'positive_over_hard_negative' WHEN a.bucket = 2 AND b.bucket = 1 THEN 'strong_positive_over_partial' WHEN a.bucket >= 1 AND b.bucket = 0 THEN 'positive_over_negative' ELSE 'positive_over_weak' END AS kind, row_number() OVER (PARTITION BY a.query_id ORDER BY a.r, b.r) AS n FROM o a JOIN o b ON a.query_id = b.query_id AND a.doc <> b.doc AND a.bucket >= 1 AND (b.bucket <= 1 OR b.negative) AND NOT (a.bucket <= b.bucket AND a.reading <= b.reading)) SELECT query_id, kind, count(*) AS pairs, sum(preferred)::BIGINT AS preferred, sum(rejected)::BIGINT AS rejected FROM p WHERE n <= 600 GROUP BY 1, 2",
    "document_excerpts": f"WITH t AS (SELECT doc_id, text, trim(regexp_replace(coalesce(regexp_replace(text, '[^ -~\\n]+', '?', 'g'), ''), '\\s+', ' ', 'g')) AS flat, lower(trim(regexp_replace(coalesce(regexp_replace(text, '[^ -~\\n]+', '?', 'g'), ''), '\\s+', ' ', 'g'))) AS low FROM documents), l AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r?\\n') AS lines FROM documents), h AS (SELECT doc_id, lines, len(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: {_HEAD.format('x')}))) AS headings, list_position(list_transform(lines, lambda x: lower(trim(x)) IN ('methods', 'method')), true) AS start FROM l), r AS (SELECT *, lines[start + 1:] AS rest FROM h), e AS (SELECT *, list_min(list_filter(list_transform(range(len(rest)), lambda i: CASE WHEN i > 0 AND ({_HEAD.format('trim(rest[i + 1])')}) THEN i END), lambda z: z IS NOT NULL)) AS stop FROM r) SELECT t.doc_id, {_at(['introduction', 'background'], 40, 0)} AS intro, {_at(['propose', 'method', 'model', 'approach'], 40, 10)} AS keyword, right(flat, 30) AS ending, headings, CASE WHEN start > 0 THEN nullif(length(trim(array_to_string(rest[1:coalesce(stop, len(rest))], chr(10)))), 0) END AS method_length FROM t JOIN e USING (doc_id)",
    "explained_papers": f"WITH {DOCS}, {SIGNALS}, s AS (SELECT *, {sql_list(list(L.SECTION_NAMES))}[doc % 4 + 1] AS section, CASE WHEN difficulty < 0.34 THEN 1.0 WHEN difficulty < 0.67 THEN 0.72 ELSE 0.28 END AS fit, lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(venue, '')) AS tt FROM signals), y AS (SELECT *, list_filter([{', '.join(_TAG_SQL)}], lambda x: x IS NOT NULL) AS tg FROM s), z AS (SELECT *, list_filter([CASE WHEN background >= 0.65 THEN 'strong query match' END, CASE WHEN 8 * citation >= 6 THEN 'strong citation signal' END, CASE WHEN recency >= 0.82 THEN 'recent paper' END, CASE WHEN fit >= 0.8 THEN 'fits selected background level' END, CASE WHEN background >= 0.5 THEN 'background-friendly framing' END, CASE WHEN method >= 0.5 THEN 'method or architecture signal' END], lambda x: x IS NOT NULL) || (CASE WHEN len(tg) = 0 THEN ['research'] ELSE tg[1:2] END) AS why FROM y) SELECT doc, array_to_string(why[1:7], '; ') AS why, CASE section WHEN 'background' THEN '' WHEN 'foundational' THEN 'Background' WHEN 'core_methods' THEN 'Background,Foundational' ELSE 'Background,Foundational,Core Methods' END AS before, CASE section WHEN 'background' THEN 'Foundational,Core Methods,Recent Frontier' WHEN 'foundational' THEN 'Core Methods,Recent Frontier' WHEN 'core_methods' THEN 'Recent Frontier' ELSE '' END AS after, round(citation + CASE WHEN doc % 2 = 0 THEN 0.25 * (method - 0.5) ELSE 0 END, 6) AS adjusted FROM z",
    "recommended": f"{BASE}, {CITED}, u AS (SELECT 'bm25' AS method, * FROM ({sql_top('bm25', 5)}) UNION ALL SELECT 'citation_recency', * FROM ({sql_top('cited', 5)})) SELECT method, query_id, doc, round(score, 6) AS score FROM u",
    "hybrid_with_vectors": f"WITH {DOCS}, {_USABLE}, queries AS (SELECT id AS query_id, title AS query, e FROM papers JOIN usable u ON u.doc = id WHERE id % 100 = 0 AND trim(title) <> ''), {TOKENS}, {QTERMS}, {BM25}, {TFIDF}, {SIGNALS}, {QSIGNALS}, sims AS (SELECT q.query_id, v.doc, list_cosine_similarity(q.e, v.e) AS score FROM queries q JOIN usable v ON v.doc <> q.query_id), {_DENSE_HYBRID} SELECT query_id, doc, round(score, 6) AS score FROM ({sql_top('hybrid_hits', 10)})",
    "topic_matches": f"WITH p AS (SELECT id, {_WORDS3} AS w FROM papers) SELECT id, round(greatest(len(list_intersect(w, ['graph', 'neural', 'network'])) / 3.0, len(list_intersect(w, ['retrieval', 'papers'])) / 2.0), 6)::DOUBLE AS match FROM p",
    "identifier_scans": "WITH a AS (SELECT DISTINCT external_id AS e FROM sample_papers WHERE external_id ILIKE 'openalex:%'), b AS (SELECT DISTINCT external_id AS e FROM sample_papers WHERE to_json({'reference_ids': reference_ids})::VARCHAR LIKE '%openalex%') SELECT 'prefix' AS scan, count(*) AS n FROM a UNION ALL SELECT 'text', count(*) FROM b UNION ALL SELECT 'text only', count(*) FROM b WHERE e NOT IN (SELECT e FROM a) UNION ALL SELECT 'both', count(*) FROM b WHERE e IN (SELECT e FROM a)",
    "method_catalogue": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in M.EXPLANATIONS.items()) + ") t(method, explanation)",
}
