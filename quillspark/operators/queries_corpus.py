"""Queries of text functions, signals, identity, graph, splits, validation and readers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import signals as G
from quillspark.functions import text as T
from quillspark.operators import corpus as C
from quillspark.operators import readers as P
from quillspark.operators import retrieval as R
from quillspark.operators.integrity import normal_identifier
from quillspark.operators.queries_integrity import _NORMAL
from quillspark.operators.queries_retrieval import BASE, HYBRID, NOW, QSIGNALS, SIGNALS, TFIDF, documents, query_table, sql_hits, sql_top
from quillspark.runtime import load
from quillspark.streaming.incremental import newer_than

_LEVELS = ["save", "not_relevant", "too_easy", "too_hard", "more_like_this"]
_KINDS = ["signup", "error", "click", "view", "purchase"]


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "papers")


# --- text and signals ---------------------------------------------------------------------------------------------------


def text_measures(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return load(spark, d, "documents").select(
        "doc_id", F.size(T.lexical_tokens(t)).alias("lexical"), F.size(T.plain_tokens(t, 3)).alias("plain"), F.size(T.word_tokens(t)).alias("words"), T.blank_word_count(t).alias("blank_words"), F.size(F.array_distinct(T.plain_tokens(t))).alias("distinct_words")
    )


def snippets(spark: SparkSession, d: str) -> DataFrame:
    c = F.regexp_replace("abstract", "[^ -~]+", "?")
    return _papers(spark, d).select("id", T.snippet(c, 80).alias("snippet"), T.first_words(c, 5).alias("first_words"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d)
    return p.select("id", T.normal_title(F.col("title")).alias("title"), T.normal_doi(F.col("doi")).alias("doi"), T.doi_url(F.col("doi")).alias("doi_url"), T.normal_id(F.col("external_id")).alias("external_id"))


def identifier_forms(spark: SparkSession, d: str) -> DataFrame:
    """arXiv and OpenAlex ids of references, whatever their spelling."""
    r = load(spark, d, "sample_papers").select(F.explode("reference_ids").alias("ref")).where("trim(ref) <> ''").distinct()
    return r.select("ref", T.arxiv_id(F.col("ref")).alias("arxiv"), F.when(F.lower("ref").contains("openalex"), T.normal_openalex(F.col("ref"))).alias("openalex"))


def paper_signals(spark: SparkSession, d: str) -> DataFrame:
    p = documents(spark, d).withColumns({"query": F.lit("graph neural network"), "bm25": F.lit(0.5), "tfidf": F.lit(0.25), "dense": F.lit(0.0)})
    s = G.query_signals(G.document_signals(p, NOW), "basic_ml")
    cols = ["relevance", "citation", "influence", "recency", "difficulty", "fit", "background", "method", "narrow", "narrow_penalty"]
    return _r(s.select("doc", *cols, G.difficulty_label(F.col("difficulty")).alias("label")), *cols)


def paper_tags(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d)
    tags = G.paper_types(F.col("title"), F.col("abstract"), F.col("venue"), F.col("citation_count"), F.col("year"), NOW)
    return p.select("id", F.array_join(tags, ",").alias("tags"), T.year_band(F.col("year")).alias("period"))


def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d).select(F.explode("categories").alias("category"), "citation_count", "year")
    return p.groupBy("category").agg(F.count(F.lit(1)).alias("papers"), F.round(F.avg("citation_count"), 6).alias("mean_citations"), F.countDistinct("year").alias("years"))


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("papers"), F.count("doi").alias("with_doi"))


def query_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of each training query with its positive text."""
    t = load(spark, d, "training_examples")
    o = T.overlap_shares(F.col("query_text"), F.col("positive_text"))
    return _r(t.select("example_id", o.alias("o"), T.phrase_hit(F.substring_index("query_text", "\n", 1), F.col("positive_text")).alias("phrase")).select("example_id", "o.overlap", "o.of_query", "o.of_text", "phrase"), "of_query", "of_text")


# --- identity and merging -----------------------------------------------------------------------------------------------


def title_groups(spark: SparkSession, d: str) -> DataFrame:
    g = C.duplicate_groups(_papers(spark, d), T.normal_title(F.col("title")), "id")
    return g.select("key", "n", F.array_join(F.col("first_rows").cast("array<string>"), ",").alias("first_rows"))


def paper_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The stored paper that each harvested record names by DOI or title."""
    h = load(spark, d, "harvest_records").select("record_id", F.lit(None).cast("string").alias("external_id"), "doi", "title")
    return C.identity_lookup(h, "record_id", _papers(spark, d).select("id", "external_id", "doi", "title"), "id")


def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    r = C.resolve_references(load(spark, d, "sample_papers"), F.col("external_id"), F.col("reference_ids"), normal_identifier)
    return r.groupBy("kind").agg(F.countDistinct("source", "reference").alias("refs"), F.countDistinct("source").alias("sources"))


def merged_records(spark: SparkSession, d: str) -> DataFrame:
    m = C.merge_records(load(spark, d, "sample_papers").withColumn("key", normal_identifier(F.col("external_id"))), "key", "fetched_at")
    return m.select("key", "citation_count", "influential_citation_count", "records", F.length("abstract").alias("abstract_length"))


def latest_records(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "sample_papers").select("external_id", "fetched_at", "citation_count")
    return C.latest(s, ["external_id"], ["fetched_at", "citation_count"]).select("external_id", "fetched_at", "citation_count")


def folded_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return C.fold_duplicates(_papers(spark, d).select("id", "external_id", "doi", "title"), "id")


def near_title_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.near_titles(_papers(spark, d), "id", "title")


# --- graph, splits, samples ----------------------------------------------------------------------------------------------


def _edges(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "citation_edges").select(F.col("source_paper_id").alias("source"), F.col("target_paper_id").alias("target"))
    return C.clean_edges(e, _papers(spark, d).select("id"))


def valid_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def citation_neighbours(spark: SparkSession, d: str) -> DataFrame:
    n = C.neighbours(_edges(spark, d), 5)
    return n.select("node", "degree", F.array_join(F.col("first_neighbours").cast("array<string>"), ",").alias("first_neighbours"))


def weak_label_queries(spark: SparkSession, d: str) -> DataFrame:
    w = C.weak_labels(_edges(spark, d), _papers(spark, d).select("id", "title"), 3, 20)
    return w.select("query_id", "query", F.size("relevant").alias("relevant"))


def repointed_edges(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d).select("id", T.normal_title(F.col("title")).alias("t")).where("t <> ''")
    low = p.groupBy("t").agg(F.min("id").alias("new"))
    moved = p.join(low, "t").where("id <> new").select(F.col("id").alias("old"), "new")
    return C.repoint(_edges(spark, d), moved)


def hash_splits(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("id", C.hash_split(13, F.col("id")).alias("split"), F.round(C.hash_share(13, F.col("id")), 9).alias("share"))


def ordinal_splits(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "training_examples").select("example_id", F.coalesce("label_source", F.lit("")).alias("label_source"))
    return C.ordinal_split(t, "label_source", "example_id")


def topic_folds(spark: SparkSession, d: str) -> DataFrame:
    return C.group_folds(_papers(spark, d), "venue", 4)


def balanced_folds(spark: SparkSession, d: str) -> DataFrame:
    return C.paired_folds(_papers(spark, d), "venue", F.coalesce("citation_count", F.lit(0)))


def training_triplets(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "training_examples").select(F.col("query_paper_id").alias("query"), F.col("positive_paper_id").alias("positive"), F.col("negative_paper_ids").alias("negatives"))
    return C.triplets(t, 17, 3)


def balanced_examples(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d).select("id", F.coalesce(F.col("citation_count") >= 20, F.lit(False)).alias("cited"))
    return C.balanced_sample(p, "cited", F.col("id"), 23, 100, 0.4)


def random_negatives(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "training_examples").where("query_paper_id is not null").select(F.col("query_paper_id").alias("query"), F.col("positive_paper_id").alias("doc")).distinct()
    return C.negatives_by_hash(t.select("query").distinct(), _papers(spark, d).select(F.col("id").alias("doc")), t, 47, 3)


def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "training_examples").select("positive_paper_id", F.lower(F.trim("split")).alias("split"))
    return C.split_leakage(t, "positive_paper_id", "split")


def quota_packets(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d).where("source is not null")
    reasons = F.array_compact(F.array(F.when(F.col("year") >= 2022, "recent"), F.when(F.col("citation_count") >= 50, "cited"), F.when(F.col("doi").isNull(), "no_doi")))
    rows = p.select("source", F.col("id").alias("row"), F.coalesce("citation_count", F.lit(0)).cast("double").alias("score"), reasons.alias("reasons"))
    return C.quota_selection(rows, "source", {"recent": 4, "cited": 3, "no_doi": 2}, 12)


def export_batches(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d).select(F.coalesce("source", F.lit("unknown")).alias("source"), "id", F.length(F.coalesce("abstract", F.lit(""))).alias("size"))
    return C.size_batches(p, "source", "id", "size", 20_000)


# --- validation ----------------------------------------------------------------------------------------------------------


def record_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = {
        "title": F.length(F.trim("title")) >= 3,
        "abstract": F.length(F.trim("abstract")) >= 50,
        "year": F.col("year").between(1800, 2100),
        "citations": F.col("citation_count") >= 0,
        "authors": F.size("authors") > 0,
        "doi": F.col("doi").isNotNull(),
    }
    v = C.violations(_papers(spark, d), "id", rules)
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first"))


def edge_violations(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["citation", "reference", "related", "extends"]
    rules = {"source": F.col("source_paper_id") >= 1, "target": F.col("target_paper_id") >= 1, "self": F.col("source_paper_id") != F.col("target_paper_id"), "kind": F.lower(F.trim("relationship_type")).isin(kinds), "time": F.col("created_at").isNotNull()}
    return C.violations(load(spark, d, "citation_edges"), "edge_id", rules).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def field_report(spark: SparkSession, d: str) -> DataFrame:
    return C.missing_fields(_papers(spark, d), ["title", "abstract", "venue", "doi", "source", "external_id"])


def example_violations(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "training_examples")
    rules = {"negatives": F.size("negative_paper_ids") > 0, "positive_is_negative": ~F.coalesce(F.array_contains("negative_paper_ids", F.col("positive_paper_id")), F.lit(False)), "query": F.length(F.trim("query_text")) > 0, "split": F.lower(F.trim("split")).isin("train", "training", "val", "valid", "validation", "dev", "test")}
    return C.violations(t, "example_id", rules)


# --- readers -------------------------------------------------------------------------------------------------------------


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    kinds = dict(zip(_KINDS, _LEVELS))
    action = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    item = 1000 + F.get_json_object("props", "$.k").cast("bigint") * 7
    return e.select(F.col("user_id").alias("user"), item.alias("item"), action.alias("action"), F.when(F.col("value") > 50, "advanced").when(F.col("value") > 20, "basic_ml").alias("level"), "ts", F.array(F.lit(" Graph "), F.col("event_type")).alias("tags"))


def reader_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = P.profile_fold(_feedback(spark, d))
    return p.select("user", "level", "events", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in P.LISTS])


def feedback_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.action_counts(_feedback(spark, d))


def reader_library(spark: SparkSession, d: str) -> DataFrame:
    return P.library(_feedback(spark, d), " GRAPH ").select("user", "item", F.array_join("tags", ",").alias("tags"), "updated")


def personal_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of documents for the readers with a number divisible by 100."""
    prof = P.profile_fold(_feedback(spark, d).where("user % 100 = 0"))
    return _r(P.personal_scores(_papers(spark, d).select(F.col("id").alias("doc"), "title", "abstract"), prof), "score", "saved_similarity", "skipped_similarity")


def corpus_signature(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).agg(F.count("id").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("last"), F.max("updated_at").alias("updated"))


def newer_records(spark: SparkSession, d: str) -> DataFrame:
    """Records fetched after the start of 2025; those without a time are left out."""
    return newer_than(load(spark, d, "sample_papers"), "fetched_at", "2025-01-01 00:00:00").select("external_id", "fetched_at")


def reading_paths(spark: SparkSession, d: str) -> DataFrame:
    """Planned reading list of every manual query: hybrid candidates, scored for four sections and filled in order."""
    docs, q = documents(spark, d), query_table(spark, d)
    pool = R.hybrid(docs, q, 50, now=NOW)
    scored = P.section_scores(pool)
    path = P.reading_path(scored.withColumn("section_score", F.round("section_score", 9)), 3)
    return path.select("query_id", "section", "place", "doc", F.round("section_score", 6).alias("section_score"), G.confidence_label(F.col("section_score")).alias("confidence"))


def duplicate_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d).select(F.lit("all").alias("query_id"), F.col("id").alias("doc"), "external_id", "doi", "title", F.lit(0.0).alias("score"), "year", "citation_count")
    return P.duplicate_penalties(p).where("duplicate > 0").groupBy("duplicate").agg(F.count(F.lit(1)).alias("n"))


def hybrid_top_sources(spark: SparkSession, d: str) -> DataFrame:
    """Where the best lexical results come from."""
    best = R.bm25_top(documents(spark, d).select("doc", "text"), query_table(spark, d), 10)
    return best.join(_papers(spark, d).select(F.col("id").alias("doc"), F.coalesce("source", F.lit("unknown")).alias("source")), "doc").groupBy("source").agg(F.count(F.lit(1)).alias("results"), F.countDistinct("query_id").alias("queries"))


QUERIES = {
    f.__name__: f
    for f in (
        text_measures, snippets, identifiers, identifier_forms, paper_signals, paper_tags, topic_counts, source_counts, query_overlap, title_groups, paper_lookup, reference_edges, merged_records, latest_records,
        folded_duplicates, near_title_pairs, valid_edges, citation_neighbours, weak_label_queries, repointed_edges, hash_splits, ordinal_splits, topic_folds, balanced_folds, training_triplets, balanced_examples,
        random_negatives, split_leaks, quota_packets, export_batches, record_violations, edge_violations, field_report, example_violations, reader_profiles, feedback_summary, reader_library, personal_scores,
        corpus_signature, newer_records, reading_paths, duplicate_candidates, hybrid_top_sources,
    )
}

# --- the same in SQL -----------------------------------------------------------------------------------------------------
_TITLE = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"
_DOI = "nullif(trim(regexp_replace(lower(trim(doi)), '^(https?://doi\\.org/|doi:)\\s*', '')), '')"
_ASCII = "regexp_replace(coalesce(abstract, ''), '[^ -~]+', '?', 'g')"
_FLAT = f"trim(regexp_replace({_ASCII}, '\\s+', ' ', 'g'))"
_E = "edges AS (SELECT DISTINCT source_paper_id AS source, target_paper_id AS target FROM citation_edges WHERE source_paper_id <> target_paper_id AND source_paper_id IN (SELECT id FROM papers) AND target_paper_id IN (SELECT id FROM papers))"
_NEAR = "near AS (SELECT DISTINCT source AS node, target AS other FROM edges UNION SELECT target, source FROM edges)"
_SHARE = "(('0x' || substr(sha256('{0}:' || {1}::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE)"
_KEYS = "list_filter([CASE WHEN trim({0}.external_id) <> '' THEN 'external_id:' || lower(trim({0}.external_id)) END, 'doi:' || " + _DOI.replace("doi)", "{0}.doi)", 1) + ", 'title:' || nullif(" + _TITLE.replace("title", "{0}.title") + ", '')], lambda x: x IS NOT NULL)"
_ACTION = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in zip(_KINDS, _LEVELS)) + " END"
_F = f"fb AS (SELECT user_id AS \"user\", 1000 + (props->>'$.k')::BIGINT * 7 AS item, {_ACTION} AS action, CASE WHEN value > 50 THEN 'advanced' WHEN value > 20 THEN 'basic_ml' END AS level, ts, event_type FROM events)"


def _rule(rules: dict[str, str], source: str, row: str) -> str:
    return " UNION ALL ".join(f"SELECT {row}, '{n}' AS rule FROM {source} WHERE NOT coalesce({c}, false)" for n, c in rules.items())


def _joined(list_name: str, actions: list[str]) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct(list(item) FILTER (action IN ({', '.join(repr(a) for a in actions)})))), ','), '') AS {list_name}"


_RULES_P = {"title": "length(trim(title)) >= 3", "abstract": "length(trim(abstract)) >= 50", "year": "year BETWEEN 1800 AND 2100", "citations": "citation_count >= 0", "authors": "len(authors) > 0", "doi": "doi IS NOT NULL"}
_RULES_E = {"source": "source_paper_id >= 1", "target": "target_paper_id >= 1", "self": "source_paper_id <> target_paper_id", "kind": "lower(trim(relationship_type)) IN ('citation', 'reference', 'related', 'extends')", "time": "created_at IS NOT NULL"}
_RULES_T = {"negatives": "len(negative_paper_ids) > 0", "positive_is_negative": "NOT coalesce(list_contains(negative_paper_ids, positive_paper_id), false)", "query": "length(trim(query_text)) > 0", "split": "lower(trim(split)) IN ('train', 'training', 'val', 'valid', 'validation', 'dev', 'test')"}
_TAGS = []
for _tag, _terms in G.TYPE_TERMS.items():
    _cond = f"{sql_hits('txt', _terms)} > 0" + (" OR coalesce(citation_count, 0) >= 1000" if _tag == "foundation" else "")
    _TAGS.append(f"CASE WHEN {_cond} THEN '{_tag}' END")
_TAGS.append(f"CASE WHEN year >= {NOW} - 3 THEN 'frontier' END")
_PT = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


def _section(name: str) -> str:
    part = {"age": "(1 - recency)", "duplicate": "0", "fit": "fit", "narrow_penalty": "narrow_penalty", "generic_narrow": "narrow * generic"}
    total = " + ".join(f"({w}) * {part.get(n, n)}" for n, w in G.SECTION_WEIGHTS[name].items())
    return f"round({total}, 9)"


_FULL = HYBRID.replace("mixed AS (SELECT w.query_id, w.doc, s.*, q.*,", "mixed AS (SELECT w.query_id, w.doc, s.* EXCLUDE (doc), q.* EXCLUDE (query_id),").replace(", 80)", ", 400)").replace("<= 80", "<= 400")
_PATHS = f"""{BASE}, {TFIDF}, {SIGNALS}, {QSIGNALS}, {_FULL},
cand AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM hybrid_hits QUALIFY rank <= 50),
feat AS (SELECT m.*, CASE WHEN difficulty < 0.34 THEN 1.0 WHEN difficulty < 0.67 THEN 0.72 ELSE 0.28 END AS fit, CASE WHEN narrow > 0 AND NOT domain AND greatest(citation, influence) < 0.78 THEN 0.22 * narrow * generic ELSE 0 END AS narrow_penalty FROM mixed m SEMI JOIN cand USING (query_id, doc)),
""" + ",\n".join(
    f"s{i} AS (SELECT query_id, '{s}' AS section, row_number() OVER (PARTITION BY query_id ORDER BY {_section(s)} DESC, doc) AS place, doc, {_section(s)} AS section_score FROM feat WHERE {_section(s)} >= {G.SECTION_LEAST[s]}"
    + (" AND recency >= 0.35" if s == "recent_frontier" else "")
    + "".join(f" AND (query_id, doc) NOT IN (SELECT (query_id, doc) FROM s{j})" for j in range(i))
    + " QUALIFY place <= 3)"
    for i, s in enumerate(G.SECTIONS)
)

SQL = {
    "text_measures": f"SELECT doc_id, len(coalesce(regexp_extract_all(text, '[A-Za-z0-9_]+'), [])) AS lexical, len(coalesce(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'), [])) AS plain, len(coalesce(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), [])) AS words, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\t\\n\\v\\f\\r ]+'), lambda x: x <> '')) AS blank_words, len(list_distinct(coalesce({_PT.format('text')}, []))) AS distinct_words FROM documents",
    "snippets": f"SELECT id, CASE WHEN length({_FLAT}) <= 80 THEN {_FLAT} ELSE rtrim(substr({_FLAT}, 1, 77)) || '...' END AS snippet, array_to_string(list_filter(regexp_split_to_array({_ASCII}, '\\s+'), lambda x: x <> '')[1:5], ' ') AS first_words FROM papers",
    "identifiers": f"SELECT id, {_TITLE} AS title, {_DOI} AS doi, CASE WHEN trim(regexp_replace(trim(doi), '^(https?://doi\\.org/|doi:)', '', 'i')) <> '' THEN 'https://doi.org/' || trim(regexp_replace(trim(doi), '^(https?://doi\\.org/|doi:)', '', 'i')) END AS doi_url, nullif(lower(trim(external_id)), '') AS external_id FROM papers",
    "identifier_forms": "WITH r AS (SELECT DISTINCT ref FROM (SELECT unnest(reference_ids) AS ref FROM sample_papers) WHERE trim(ref) <> '') SELECT ref, nullif(regexp_extract(lower(ref), '^\\s*(?:arxiv:|https?://arxiv\\.org/(?:abs|pdf)/)([a-z\\-]+/[0-9]{7}|[0-9]{4}\\.[0-9]{4,5})', 1), '') AS arxiv, CASE WHEN contains(lower(ref), 'openalex') THEN upper(regexp_extract(lower(trim(ref)), '(w[0-9]+)$', 1)) END AS openalex FROM r",
    "paper_signals": BASE.split(", queries AS")[0]
    + f", {SIGNALS} SELECT doc, round(0.295, 6) AS relevance, round(citation, 6) AS citation, round(influence, 6) AS influence, round(recency, 6) AS recency, difficulty, round(CASE WHEN difficulty < 0.34 THEN 1.0 WHEN difficulty < 0.67 THEN 0.72 ELSE 0.28 END, 6) AS fit, round(background, 6) AS background, round(method, 6) AS method, round(narrow, 6) AS narrow, round(CASE WHEN narrow > 0 AND greatest(citation, influence) < 0.78 THEN 0.22 * narrow ELSE 0 END, 6) AS narrow_penalty, CASE WHEN difficulty < 0.34 THEN 'beginner' WHEN difficulty < 0.67 THEN 'intermediate' ELSE 'advanced' END AS label FROM signals",
    "paper_tags": f"WITH x AS (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(venue, '')) AS txt FROM papers), y AS (SELECT id, year, list_filter([{', '.join(_TAGS)}], lambda x: x IS NOT NULL) AS t FROM x) SELECT id, CASE WHEN len(t) = 0 THEN 'research' ELSE array_to_string(t, ',') END AS tags, CASE WHEN year IS NULL THEN 'unknown' WHEN year < 2010 THEN 'pre-2010' WHEN year <= 2014 THEN '2010-2014' WHEN year <= 2018 THEN '2015-2018' WHEN year <= 2021 THEN '2019-2021' WHEN year <= 2023 THEN '2022-2023' ELSE '2024+' END AS period FROM y",
    "topic_counts": "SELECT category, count(*) AS papers, round(avg(citation_count), 6) AS mean_citations, count(DISTINCT year) AS years FROM (SELECT unnest(categories) AS category, citation_count, year FROM papers) GROUP BY 1",
    "source_counts": "SELECT coalesce(source, 'unknown') AS source, count(*) AS papers, count(doi) AS with_doi FROM papers GROUP BY 1",
    "query_overlap": f"WITH x AS (SELECT example_id, list_distinct(coalesce({_PT.format('query_text')}, [])) AS q, list_distinct(coalesce({_PT.format('positive_text')}, [])) AS t, trim(regexp_replace(lower(string_split(query_text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g')) AS p, trim(regexp_replace(lower(positive_text), '[^a-z0-9]+', ' ', 'g')) AS pt FROM training_examples) SELECT example_id, len(list_intersect(q, t)) AS overlap, round(len(list_intersect(q, t)) / greatest(len(q), 1)::DOUBLE, 6) AS of_query, round(len(list_intersect(q, t)) / greatest(len(t), 1)::DOUBLE, 6) AS of_text, p <> '' AND contains(pt, p) AS phrase FROM x",
    "title_groups": f"WITH x AS (SELECT {_TITLE} AS key, id FROM papers) SELECT key, count(*) AS n, array_to_string(list_sort(list(id))[1:5], ',') AS first_rows FROM x WHERE key <> '' GROUP BY 1 HAVING count(*) > 1",
    "paper_lookup": f"WITH k AS (SELECT id, unnest({_KEYS.format('p')}) AS key FROM papers p), t AS (SELECT key, min(id) AS target FROM k GROUP BY 1), h AS (SELECT record_id, unnest(['doi:' || {_DOI}, 'title:' || nullif({_TITLE}, '')]) AS key, unnest([1, 2]) AS strength FROM harvest_records), m AS (SELECT record_id, arg_min(target, strength) AS target, arg_min(h.key, strength) AS key FROM h JOIN t USING (key) GROUP BY 1) SELECT r.record_id, m.target, m.key FROM (SELECT DISTINCT record_id FROM harvest_records) r LEFT JOIN m USING (record_id)",
    "reference_edges": f"WITH k AS (SELECT DISTINCT {_NORMAL.format('external_id')} AS ref FROM sample_papers), o AS (SELECT DISTINCT {_NORMAL.format('external_id')} AS source, pos, reference, {_NORMAL.format('reference')} AS ref FROM (SELECT external_id, unnest(reference_ids) AS reference, unnest(range(len(reference_ids))) AS pos FROM sample_papers) WHERE reference IS NOT NULL), x AS (SELECT o.*, k.ref IS NOT NULL AS there, row_number() OVER (PARTITION BY source, o.ref ORDER BY pos, reference) AS r FROM o LEFT JOIN k ON k.ref = o.ref WHERE o.ref <> ''), y AS (SELECT source, reference, CASE WHEN NOT there THEN 'missing' WHEN ref = source THEN 'self' WHEN r > 1 THEN 'repeated' ELSE 'edge' END AS kind FROM x) SELECT kind, count(DISTINCT (source, reference)) AS refs, count(DISTINCT source) AS sources FROM y GROUP BY 1",
    "merged_records": f"SELECT {_NORMAL.format('external_id')} AS key, max(coalesce(citation_count, 0)) AS citation_count, max(coalesce(influential_citation_count, 0)) AS influential_citation_count, count(*) AS records, max(length(abstract)) AS abstract_length FROM sample_papers GROUP BY 1",
    "latest_records": "SELECT external_id, fetched_at, citation_count FROM sample_papers QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY fetched_at DESC NULLS LAST, citation_count DESC NULLS LAST) = 1",
    "valid_edges": f"WITH {_E} SELECT source, target FROM edges",
    "citation_neighbours": f"WITH {_E}, {_NEAR} SELECT node, count(*) AS degree, array_to_string(list_sort(list(other))[1:5], ',') AS first_neighbours FROM near GROUP BY 1",
    "weak_label_queries": f"WITH {_E}, {_NEAR}, d AS (SELECT node, count(*) AS degree FROM near GROUP BY 1 HAVING count(*) >= 3), f AS (SELECT unnest([0, 1, 2]) AS form, unnest(['', 'papers related to ', 'background reading for ']) AS head) SELECT node || '-' || form AS query_id, head || title AS query, least(degree, 20)::INT AS relevant FROM d JOIN papers ON id = node, f WHERE trim(title) <> ''",
    "repointed_edges": f"WITH {_E}, m AS (SELECT id AS old, min(id) OVER (PARTITION BY {_TITLE}) AS new FROM papers WHERE {_TITLE} <> ''), x AS (SELECT DISTINCT coalesce(a.new, source) AS source, coalesce(b.new, target) AS target FROM edges LEFT JOIN m a ON a.old = source LEFT JOIN m b ON b.old = target) SELECT source, target FROM x WHERE source <> target",
    "hash_splits": f"WITH x AS (SELECT id, {_SHARE.format(13, 'id')} AS u FROM papers) SELECT id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split, round(u, 9) AS share FROM x",
    "ordinal_splits": "WITH x AS (SELECT example_id, coalesce(label_source, '') AS label_source, (row_number() OVER (PARTITION BY coalesce(label_source, '') ORDER BY example_id) - 1) % 10 AS a FROM training_examples) SELECT example_id, label_source, CASE WHEN a < 7 THEN 'train' WHEN a < 8 THEN 'val' ELSE 'test' END AS split FROM x",
    "topic_folds": "SELECT venue, (row_number() OVER (ORDER BY venue) - 1) % 4 AS fold FROM (SELECT DISTINCT venue FROM papers WHERE venue IS NOT NULL)",
    "balanced_folds": "WITH w AS (SELECT venue, sum(coalesce(citation_count, 0)) AS w FROM papers WHERE venue IS NOT NULL GROUP BY 1), r AS (SELECT venue, row_number() OVER (ORDER BY w, venue) AS fold, count(*) OVER () AS n FROM w) SELECT a.fold, a.venue AS first, b.venue AS second FROM r a JOIN r b ON b.fold = a.n - a.fold + 1 WHERE a.fold * 2 <= a.n + 1",
    "training_triplets": f"WITH t AS (SELECT DISTINCT query, positive, negative FROM (SELECT query_paper_id AS query, positive_paper_id AS positive, unnest(negative_paper_ids) AS negative FROM training_examples) WHERE negative IS NOT NULL AND negative <> positive) SELECT query, positive, negative FROM t QUALIFY row_number() OVER (PARTITION BY query ORDER BY {_SHARE.format(17, '(' + chr(39) + chr(39) + ' || query || ' + chr(39) + ':' + chr(39) + ' || positive || ' + chr(39) + ':' + chr(39) + ' || negative)')}, positive, negative) <= 3",
    "random_negatives": "WITH t AS (SELECT DISTINCT query_paper_id AS query, positive_paper_id AS doc FROM training_examples WHERE query_paper_id IS NOT NULL), q AS (SELECT DISTINCT query, ('0x' || substr(sha256('48:' || query), 1, 8))::BIGINT AS start FROM t), p AS (SELECT DISTINCT id AS doc, ('0x' || substr(sha256('47:' || id), 1, 8))::BIGINT AS pos FROM papers) SELECT query, p.doc FROM q, p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.query = q.query AND t.doc = p.doc) QUALIFY row_number() OVER (PARTITION BY query ORDER BY (pos - start + 4294967296) % 4294967296, p.doc) <= 3",
    "balanced_examples": f"WITH p AS (SELECT id, coalesce(citation_count >= 20, false) AS cited, {_SHARE.format(23, 'id')} AS u FROM papers), n AS (SELECT sum(cited::INT) AS a, sum((NOT cited)::INT) AS b FROM p), w AS (SELECT a, b, least(greatest(40, 100 - b), a) AS want FROM n), r AS (SELECT p.*, row_number() OVER (PARTITION BY cited ORDER BY u, id) AS r FROM p) SELECT id, cited FROM r, w WHERE r <= CASE WHEN cited THEN want ELSE least(100 - want, b) END",
    "quota_packets": f"WITH rows AS (SELECT source, id AS row, coalesce(citation_count, 0)::DOUBLE AS score, year >= 2022 AS recent, citation_count >= 50 AS cited, doi IS NULL AS no_doi FROM papers WHERE source IS NOT NULL), a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, row) AS r FROM rows WHERE recent QUALIFY r <= 4), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, row) AS r FROM rows WHERE cited AND row NOT IN (SELECT row FROM a) QUALIFY r <= 3), c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, row) AS r FROM rows WHERE no_doi AND row NOT IN (SELECT row FROM a UNION SELECT row FROM b) QUALIFY r <= 2), f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, row) AS r FROM rows WHERE row NOT IN (SELECT row FROM a UNION SELECT row FROM b UNION SELECT row FROM c)), u AS (SELECT source, row, 'recent' AS picked_for, 0 AS step, r FROM a UNION ALL SELECT source, row, 'cited', 1, r FROM b UNION ALL SELECT source, row, 'no_doi', 2, r FROM c UNION ALL SELECT source, row, 'fill', 3, r FROM f) SELECT source, row, picked_for, row_number() OVER (PARTITION BY source ORDER BY step, r) AS place FROM u QUALIFY place <= 12",
    "export_batches": "WITH RECURSIVE p AS (SELECT coalesce(source, 'unknown') AS source, id, length(coalesce(abstract, '')) AS size, row_number() OVER (PARTITION BY coalesce(source, 'unknown') ORDER BY id) AS r FROM papers), w AS (SELECT source, id, size, r, size AS total, 0 AS batch FROM p WHERE r = 1 UNION ALL SELECT p.source, p.id, p.size, p.r, CASE WHEN w.total > 0 AND w.total + p.size > 20000 THEN p.size ELSE w.total + p.size END, CASE WHEN w.total > 0 AND w.total + p.size > 20000 THEN w.batch + 1 ELSE w.batch END FROM w JOIN p ON p.source = w.source AND p.r = w.r + 1) SELECT source, id, size, batch FROM w",
    "personal_scores": f"WITH {_F}, l AS (SELECT DISTINCT \"user\", CASE WHEN action IN ('save', 'more_like_this') THEN 'saved' WHEN action = 'not_relevant' THEN 'skipped' END AS list, item FROM fb WHERE \"user\" % 100 = 0), w AS (SELECT id AS doc, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[a-z0-9]{{3,}}'))) AS w FROM papers), n AS (SELECT doc, count(*) AS n FROM w GROUP BY 1), near AS (SELECT a.doc AS item, b.doc, count(*) AS shared FROM w a JOIN w b USING (w) WHERE a.doc IN (SELECT item FROM l WHERE list IS NOT NULL) GROUP BY 1, 2), s AS (SELECT item, near.doc, shared / (n.n + m.n - shared)::DOUBLE AS s FROM near JOIN n ON n.doc = near.doc JOIN n m ON m.doc = near.item), g AS (SELECT \"user\", doc, coalesce(max(CASE WHEN list = 'saved' THEN s END), 0) AS saved_similarity, coalesce(max(CASE WHEN list = 'skipped' THEN s END), 0) AS skipped_similarity, max((list = 'saved' AND item = doc)::INT) AS saved, max((list = 'skipped' AND item = doc)::INT) AS skipped FROM l JOIN s USING (item) WHERE list IS NOT NULL GROUP BY 1, 2) SELECT \"user\", doc, round(greatest(least(0.10 * saved + 0.12 * saved_similarity - 0.30 * skipped - 0.12 * skipped_similarity, 0.25), -0.45), 6) AS score, round(saved_similarity, 6) AS saved_similarity, round(skipped_similarity, 6) AS skipped_similarity FROM g",
    "split_leaks": "SELECT positive_paper_id, count(DISTINCT lower(trim(split))) AS splits FROM training_examples WHERE split IS NOT NULL AND positive_paper_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1",
    "record_violations": f"SELECT rule, count(*) AS rows, min(id) AS first FROM ({_rule(_RULES_P, 'papers', 'id')}) GROUP BY 1",
    "edge_violations": f"SELECT rule, count(*) AS rows FROM ({_rule(_RULES_E, 'citation_edges', 'edge_id')}) GROUP BY 1",
    "field_report": " UNION ALL ".join(f"SELECT '{c}' AS field, sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)::BIGINT AS nulls, sum(CASE WHEN trim({c}) = '' THEN 1 ELSE 0 END)::BIGINT AS blanks, sum(CASE WHEN trim({c}) <> '' THEN 1 ELSE 0 END)::BIGINT AS filled, count(DISTINCT {c}) AS distinct FROM papers" for c in ("title", "abstract", "venue", "doi", "source", "external_id")),
    "example_violations": _rule(_RULES_T, "training_examples", "example_id"),
    "reader_profiles": f"WITH {_F} SELECT \"user\", arg_max(level, (ts, item)) FILTER (level IS NOT NULL) AS level, count(*) AS events, {_joined('saved', ['save', 'more_like_this'])}, {_joined('skipped', ['not_relevant'])}, {_joined('too_easy', ['too_easy'])}, {_joined('too_hard', ['too_hard'])} FROM fb GROUP BY 1",
    "feedback_summary": f"WITH {_F} SELECT action, count(*) AS n, count(DISTINCT \"user\") AS users FROM fb GROUP BY 1",
    "reader_library": f"WITH {_F} SELECT \"user\", item, 'graph,signup' AS tags, max(ts) AS updated FROM fb WHERE action = 'save' GROUP BY 1, 2",
    "corpus_signature": "SELECT count(id) AS n, coalesce(max(id), 0) AS last, max(updated_at) AS updated FROM papers",
    "newer_records": "SELECT external_id, fetched_at FROM sample_papers WHERE fetched_at > TIMESTAMPTZ '2025-01-01 00:00:00+00'",
    "reading_paths": _PATHS + "\nSELECT query_id, section, place, doc, round(section_score, 6) AS section_score, CASE WHEN section_score >= 0.72 THEN 'high' WHEN section_score >= 0.45 THEN 'medium' ELSE 'low' END AS confidence FROM (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(4)) + ")",
    "hybrid_top_sources": f"{BASE}, best AS ({sql_top('bm25', 10)}) SELECT coalesce(source, 'unknown') AS source, count(*) AS results, count(DISTINCT query_id) AS queries FROM best JOIN papers ON id = doc GROUP BY 1",
}
