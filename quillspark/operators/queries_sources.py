"""Queries that go through files, ingest and streams and must come out as the tables say, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import labels as L
from quillspark.functions import text as T
from quillspark.operators import ingest as I
from quillspark.operators.corpus import override
from quillspark.operators.integrity import normal_identifier
from quillspark.operators.queries_integrity import _NORMAL
from quillspark.operators.readers import ACTION_LISTS, patch
from quillspark.runtime import load, tables_dir
from quillspark.sources import readers as R
from quillspark.sources import sinks as K
from quillspark.streaming import incremental as W


def _place(spark: SparkSession, tag: str) -> str:
    return f"{tables_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sample_papers").withColumnRenamed("reference_ids", "references")


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Ingest records written as JSON lines and read by the typed reader."""
    path = _place(spark, "records") + ".jsonl"
    K.write_json_lines(_records(spark, d).drop("fetched_at"), path)
    rows, bad = R.read_json_lines(spark, path)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("doi").alias("dois"), F.sum(F.size("references")).cast("bigint").alias("refs")).withColumn("bad", F.lit(bad.count()))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Titles with quotes, commas and line breaks through CSV."""
    path = _place(spark, "papers") + ".csv"
    K.write_csv(load(spark, d, "papers").select("id", "title", "year", "abstract"), path, ["id", "title", "year", "abstract", "absent"])
    return R.read_records(spark, path, "id bigint, title string, year int, abstract string, absent string").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("title")).alias("letters"), F.count("absent").alias("absent"))


def xml_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Papers as harvested XML records, some of them deleted."""
    path = _place(spark, "harvest") + ".xml"
    p = load(spark, d, "papers").where("trim(title) <> '' and trim(abstract) <> ''")
    arxiv = F.struct(F.col("id").cast("string").alias("id"), F.regexp_replace("title", "[^ -~]", "?").alias("title"), F.regexp_replace("abstract", "[^ -~]", "?").alias("abstract"), F.concat("year", F.lit("-01-02")).alias("created"), F.array_join("categories", " ").alias("categories"))
    rows = p.select(F.struct(F.when(F.col("id") % 7 == 0, "deleted").alias("_status"), F.concat(F.lit("oai:"), "id").alias("identifier")).alias("header"), F.struct(arxiv.alias("arXiv")).alias("metadata"))
    rows.write.format("xml").option("rowTag", "record").option("rootTag", "list").save(path)
    return R.read_harvest_xml(spark, path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("external_id").alias("ids"))


def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Manifest of a dataset, the latest of two."""
    folder = _place(spark, "manifests")
    p = load(spark, d, "papers").select("id", "doi", "abstract")
    K.write_manifest(p.limit(3), folder, "first set", 3, 0, [], [])
    K.write_manifest(p, folder, "second set!", 5, 2, ["e"], ["w", "x"])
    m = K.latest_manifest(spark, folder)
    return m.select("name", "rows", F.col("filled")["doi"].alias("dois"), "inserted", "skipped", F.size("errors").alias("errors"), F.size("warnings").alias("warnings"))


def cached_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores kept in an append-only table: the second run computes only what the first did not."""
    path = _place(spark, "scores")
    p = load(spark, d, "papers").select("id", F.length(F.coalesce("title", F.lit(""))).alias("score"))
    K.append_missing(path, p.where("id % 2 = 0"), ["id"], lambda x: x.withColumn("run", F.lit(1)))
    return K.append_missing(path, p, ["id"], lambda x: x.withColumn("run", F.lit(2))).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


def catalogue_works(spark: SparkSession, d: str) -> DataFrame:
    """Stored records as catalogue works with inverted abstracts, filtered and turned back into records."""
    s = load(spark, d, "sample_papers").where("trim(title) <> '' and trim(abstract) <> ''")
    words = F.filter(F.split(F.regexp_replace("abstract", "[^ -~]", "?"), r"\s+"), lambda x: x != "")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))))
    named = lambda c: F.transform(c, lambda x: F.struct(x.alias("display_name")))
    w = s.select(
        F.concat(F.lit("https://openalex.org/W"), F.abs(F.xxhash64("external_id"))).alias("id"), "doi", "title", F.col("year").alias("publication_year"), F.col("citation_count").alias("cited_by_count"), index.alias("abstract_inverted_index"),
        F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), named(F.col("categories")).alias("topics"), named(F.array().cast("array<string>")).alias("keywords"), F.col("reference_ids").alias("referenced_works"), F.lit("article").alias("type"),
    )
    r = R.works_to_records(w.where((F.col("type") == "article") & F.col("publication_year").between(2000, 2024) & (F.col("cited_by_count") >= 1)))
    return r.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("abstract")).alias("letters"), F.sum(F.coalesce(F.size("categories"), F.lit(0))).alias("categories"))


def ingested_counts(spark: SparkSession, d: str) -> DataFrame:
    """Ingest of the sample records into the stored papers: what is rejected, merged, new and linked."""
    rules = {"title": F.length(F.trim("title")) >= 3, "abstract": F.length(F.trim("abstract")) >= 20}
    return I.ingest(load(spark, d, "papers"), _records(spark, d), rules, normal_identifier)["counts"]


def source_upserts(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "papers")
    stored = p.where("source is not null").select(F.col("id").alias("paper_id"), "source", F.col("external_id").alias("key"), "url", F.lit(None).cast("string").alias("body"))
    new = p.where("source is not null and id % 3 = 0").select(F.col("id").alias("paper_id"), "source", F.when(F.col("id") % 2 == 0, F.col("external_id")).otherwise("other").alias("key"), F.lit(None).cast("string").alias("url"), F.lit("{}").alias("body"))
    return I.upsert_sources(stored, new).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("url").alias("urls"), F.count("body").alias("bodies"))


def missing_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that papers have and an identifier table lacks, counted before anything is written."""
    p = load(spark, d, "papers")
    kinds = {"doi": T.normal_doi(F.col("doi")), "external": T.normal_id(F.col("external_id"))}
    known = p.where("id % 2 = 0").select(F.col("id").alias("paper_id"), F.lit("doi").alias("kind"), T.normal_doi(F.col("doi")).alias("value"))
    return I.backfill(p, known, kinds).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def dataset_state(spark: SparkSession, d: str) -> DataFrame:
    return I.dataset_status(load(spark, d, "papers"), load(spark, d, "citation_edges"))


def service_health(spark: SparkSession, d: str) -> DataFrame:
    return I.health(spark).select("status")


def text_locations(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "papers")
    arxiv = T.arxiv_id(F.col("external_id"), F.col("doi"))
    where = I.text_location(arxiv, F.array(F.concat("url", F.when(F.col("id") % 2 == 0, ".pdf").otherwise("")), F.col("source_url")), L.allowed_pdf, F.when(F.col("id") % 3 == 0, F.col("source_url")))
    return p.groupBy(F.coalesce(where["kind"], F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def more_text_functions(spark: SparkSession, d: str) -> DataFrame:
    """List, number and identifier functions over stored columns."""
    p = load(spark, d, "papers")
    c = F.col("citation_count").cast("double")
    return p.select(
        "id", F.array_join(T.union_lists(F.col("categories"), F.array(F.lit("AI.agents"), F.lit(" x "))), ",").alias("merged"), F.size(T.split_list(F.array_join("authors", "; "))).alias("authors"),
        F.array_join(T.json_ints(F.concat(F.lit("["), F.coalesce("year", F.lit(0)), F.lit(", 3, 3]"))).cast("array<string>"), ",").alias("numbers"), T.quantise(c / 100).alias("step"), F.round(T.reciprocal_rank(F.col("citation_count")), 6).alias("reciprocal"),
        F.round(T.clamp(c / 50), 6).alias("clamped"), T.normal_arxiv(F.col("external_id")).alias("arxiv"), T.parse_time(F.concat(F.col("year"), F.lit("-03-04"))).alias("day"), F.length(T.model_text(F.lit("q"), F.lit("t"), F.regexp_replace("abstract", "[^ -~]", "?"), 5)).alias("letters"),
    )


def overridden_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labels overridden by key and profiles patched field by field."""
    p = load(spark, d, "papers").select("id", "venue", "year")
    over = p.where("id % 4 = 0").select("id", F.lit("override").alias("venue"), "year")
    change = p.where("id % 3 = 0").select("id", F.lit(None).cast("string").alias("venue"), F.lit(1900).alias("year"))
    return patch(override(p, over, ["id"]), change, "id").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("venue") == "override").cast("int")).alias("overridden"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*").select(F.col("user_id").alias("user"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("bigint").alias("item"))


def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts through a stream that reads what is there and ends."""
    out, name = _place(spark, "windows"), "w" + uuid.uuid4().hex
    query = W.windowed_counts(_stream(spark, d)).writeStream.queryName(name).outputMode("append").format("parquet").option("path", out).option("checkpointLocation", _place(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("start timestamp, end timestamp, action string, n bigint").parquet(out)
    return rows.groupBy("action").agg(F.sum((F.col("start") < F.to_timestamp(F.lit("2024-01-02 00:00:00"))).cast("int") * F.col("n")).cast("bigint").alias("first_day"))


def streamed_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of every reader, kept by a stream of upserts."""
    out = _place(spark, "latest")
    query = W.upsert_stream(_stream(spark, d).select("user", "action", "ts"), out, ["user"], ["ts", "action"], _place(spark, "state"))
    query.awaitTermination()
    return W.current(spark, out).select("user", "action", "ts")


def reader_lists(spark: SparkSession, d: str) -> DataFrame:
    """Profile lists as a running aggregation would give them."""
    kinds = dict(zip(["signup", "error", "click", "view", "purchase"], ["save", "not_relevant", "too_easy", "too_hard", "more_like_this"]))
    action = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    e = load(spark, d, "events").select(F.col("user_id").alias("user"), action.alias("action"), "ts", F.get_json_object("props", "$.k").cast("bigint").alias("item"))
    return W.profile_stream(e).select("user", "list", F.size("items").alias("items"), "last")


QUERIES = {
    f.__name__: f
    for f in (
        json_round_trip, csv_round_trip, xml_round_trip, manifest_round_trip, cached_scores, catalogue_works, ingested_counts, source_upserts, missing_identifiers, dataset_state, service_health, text_locations,
        more_text_functions, overridden_rows, streamed_windows, streamed_latest, reader_lists,
    )
}

_K = {"signup": "save", "error": "not_relevant", "click": "too_easy", "view": "too_hard", "purchase": "more_like_this"}
_LIST = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{ACTION_LISTS[a]}'" for e, a in _K.items()) + " END"
_DOI = "nullif(trim(regexp_replace(lower(trim(doi)), '^(https?://doi\\.org/|doi:)\\s*', '')), '')"
_KEY = "coalesce('external_id:' || nullif(lower(trim(external_id)), ''), 'doi:' || " + _DOI + ", 'title:' || nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ''))"
_HOST, _PATH = "lower(regexp_extract({0}, '^https://([^/?#]+)', 1))", "lower(regexp_extract({0}, '^https://[^/?#]+([^?#]*)', 1))"
_OK = lambda u: f"coalesce({_HOST.format(u)} <> '' AND CASE WHEN ends_with({_HOST.format(u)}, 'arxiv.org') THEN starts_with({_PATH.format(u)}, '/pdf/') ELSE ends_with({_PATH.format(u)}, '.pdf') END, false)"
_ARX = "nullif(regexp_extract(lower(coalesce(external_id, '')), '^\\s*arxiv:\\s*([a-z\\-]+/[0-9]{7}|[0-9]{4}\\.[0-9]{4,5})', 1), '')"
_KEYS = lambda t: f"['external_id:' || nullif(lower(trim({t}.external_id)), ''), 'doi:' || {_DOI.replace('doi)', t + '.doi)', 1)}, 'title:' || nullif(trim(regexp_replace(lower({t}.title), '[^a-z0-9]+', ' ', 'g')), '')]"
SQL = {
    "json_round_trip": "SELECT source, count(*) AS n, count(doi) AS dois, sum(CASE WHEN reference_ids IS NULL THEN NULL ELSE len(reference_ids) END)::BIGINT AS refs, 0 AS bad FROM sample_papers GROUP BY 1",
    "csv_round_trip": "SELECT year, count(*) AS n, sum(length(title))::BIGINT AS letters, 0 AS absent FROM papers GROUP BY 1",
    "xml_round_trip": "SELECT year, count(*) AS n, count(DISTINCT id) AS ids FROM papers WHERE trim(title) <> '' AND trim(abstract) <> '' AND id % 7 <> 0 GROUP BY 1",
    "manifest_round_trip": "SELECT 'second set!' AS name, count(*) AS rows, count(doi) AS dois, 5 AS inserted, 2 AS skipped, 1 AS errors, 2 AS warnings FROM papers",
    "cached_scores": "SELECT CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS run, count(*) AS n, sum(length(coalesce(title, '')))::BIGINT AS total FROM papers GROUP BY 1",
    "catalogue_works": "SELECT year, count(*) AS n, sum(length(trim(regexp_replace(regexp_replace(abstract, '[^ -~]', '?', 'g'), '\\s+', ' ', 'g'))))::BIGINT AS letters, sum(coalesce(len(list_distinct(list_filter(list_transform(categories, lambda c: lower(trim(c))), lambda c: c <> ''))), 0))::BIGINT AS categories FROM sample_papers WHERE trim(title) <> '' AND trim(abstract) <> '' AND year BETWEEN 2000 AND 2024 AND citation_count >= 1 GROUP BY 1",
    "ingested_counts": f"WITH r AS (SELECT external_id, doi, title, reference_ids AS refs, length(trim(title)) >= 3 AND length(trim(abstract)) >= 20 AS ok FROM sample_papers), v AS (SELECT *, {_KEY} AS key FROM r WHERE coalesce(ok, false)), f AS (SELECT * FROM v WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY external_id NULLS FIRST, title NULLS FIRST, doi NULLS FIRST) = 1), pk AS (SELECT id, {_KEYS('papers')} AS ks FROM papers), pu AS (SELECT id, unnest(ks) AS k FROM pk), pt AS (SELECT k, min(id) AS target FROM pu GROUP BY 1), fk AS (SELECT key, unnest({_KEYS('f')}) AS k, unnest([1, 2, 3]) AS s FROM f), m AS (SELECT key, arg_min(target, s) AS target FROM fk JOIN pt USING (k) GROUP BY 1), ids AS (SELECT f.*, m.target, coalesce(m.target::VARCHAR, 'n' || f.key) AS id FROM f LEFT JOIN m USING (key)), named AS (SELECT ref, arg_min(id, (o, id)) AS id FROM (SELECT {_NORMAL.format('external_id')} AS ref, id::VARCHAR AS id, 0 AS o FROM papers UNION ALL SELECT {_NORMAL.format('external_id')}, id, CASE WHEN target IS NULL THEN 1 ELSE 0 END FROM ids) WHERE ref <> '' GROUP BY 1), e AS (SELECT DISTINCT x.id AS a, n.id AS b FROM (SELECT id, {_NORMAL.format('u')} AS ref FROM (SELECT ids.id, unnest(v.refs) AS u FROM ids JOIN v USING (key))) x JOIN named n ON n.ref = x.ref WHERE x.ref <> '' AND x.id <> n.id) SELECT 'records' AS what, count(*) AS n FROM r UNION ALL SELECT 'rejected', count(DISTINCT (coalesce(external_id, ''), coalesce(title, ''), coalesce(doi, ''))) FROM r WHERE NOT coalesce(ok, false) UNION ALL SELECT 'inserted', count(*) FROM ids WHERE target IS NULL UNION ALL SELECT 'merged', count(*) FROM ids WHERE target IS NOT NULL UNION ALL SELECT 'edges', count(*) FROM e",
    "source_upserts": "WITH s AS (SELECT id, source, external_id AS key, url, NULL AS body FROM papers WHERE source IS NOT NULL), n AS (SELECT id, source, CASE WHEN id % 2 = 0 THEN external_id ELSE 'other' END AS key FROM papers WHERE source IS NOT NULL AND id % 3 = 0), u AS (SELECT coalesce(s.source, n.source) AS source, s.url, CASE WHEN n.id IS NOT NULL THEN '{}' END AS body FROM s FULL JOIN n ON s.id = n.id AND s.source = n.source AND s.key = n.key) SELECT source, count(*) AS n, count(url) AS urls, count(body) AS bodies FROM u GROUP BY 1",
    "missing_identifiers": f"SELECT 'doi' AS kind, count(*) AS n FROM (SELECT DISTINCT id, {_DOI} AS v FROM papers WHERE id % 2 <> 0) WHERE v IS NOT NULL UNION ALL SELECT 'external', count(*) FROM (SELECT DISTINCT id, nullif(lower(trim(external_id)), '') AS v FROM papers) WHERE v IS NOT NULL",
    "dataset_state": "SELECT count(*) AS papers, sum((trim(coalesce(abstract, '')) <> '')::INT) AS with_abstract, count(DISTINCT source) AS sources, min(year) AS first_year, max(year) AS last_year, max(updated_at) AS updated, (SELECT count(*) FROM citation_edges) AS edges, count(*) > 0 AS ready FROM papers",
    "service_health": "SELECT 'ok' AS status",
    "text_locations": f"WITH x AS (SELECT *, url || CASE WHEN id % 2 = 0 THEN '.pdf' ELSE '' END AS u FROM papers) SELECT CASE WHEN {_ARX} IS NOT NULL THEN 'arxiv' WHEN {_OK('u')} OR {_OK('source_url')} THEN 'direct' WHEN id % 3 = 0 AND source_url IS NOT NULL THEN 'open' ELSE 'none' END AS kind, count(*) AS n FROM x GROUP BY 1",
    "more_text_functions": "WITH p AS (SELECT *, list_transform(list_filter(coalesce(categories, []), lambda x: trim(x) <> ''), lambda x: trim(x)) AS cs FROM papers) SELECT id, array_to_string(list_filter(list_concat(cs, ['AI.agents', 'x']), lambda x, i: len(list_filter(list_concat(cs, ['AI.agents', 'x'])[1:i - 1], lambda y: lower(y) = lower(x))) = 0), ',') AS merged, len(list_filter(string_split(coalesce(array_to_string(authors, '; '), ''), ';'), lambda x: trim(x) <> '')) AS authors, array_to_string(list_sort(list_distinct([coalesce(year, 0), 3])), ',') AS numbers, CASE WHEN citation_count / 100.0 <= 0.25 THEN 0.0 WHEN citation_count / 100.0 < 0.75 THEN 0.5 ELSE 1.0 END::DOUBLE AS step, round(CASE WHEN citation_count BETWEEN 1 AND 999998 THEN 1.0 / citation_count ELSE 0 END, 6) AS reciprocal, round(least(greatest(coalesce(citation_count / 50.0, 0), 0), 1), 6)::DOUBLE AS clamped, regexp_replace(regexp_replace(lower(trim(external_id)), '^arxiv:\\s*', ''), 'v[0-9]+$', '') AS arxiv, make_timestamp(year, 3, 4, 0, 0, 0) AS day, length('query: q title: t abstract: ' || array_to_string(list_filter(regexp_split_to_array(regexp_replace(coalesce(abstract, ''), '[^ -~]', '?', 'g'), '\\s+'), lambda x: x <> '')[1:5], ' ')) AS letters FROM p",
    "overridden_rows": "SELECT CASE WHEN id % 3 = 0 THEN 1900 ELSE year END AS year, count(*) AS n, sum(CASE WHEN id % 4 = 0 THEN 1 WHEN venue IS NULL THEN NULL ELSE (venue = 'override')::INT END) AS overridden FROM papers GROUP BY 1",
    "streamed_windows": "SELECT event_type AS action, sum((ts < TIMESTAMP '2024-01-02 00:00:00')::INT)::BIGINT AS first_day FROM events GROUP BY 1",
    "streamed_latest": 'SELECT user_id AS "user", arg_max(event_type, (ts, event_type)) AS action, max(ts) AS ts FROM events GROUP BY 1',
    "reader_lists": f"SELECT user_id AS \"user\", {_LIST} AS list, count(DISTINCT (props->>'$.k')::BIGINT) AS items, max(ts) AS last FROM events GROUP BY 1, 2",
}
