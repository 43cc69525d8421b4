"""Ingest of record files into stored papers, sources and edges, as one run of table plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import identity_keys
from quillspark.operators.corpus import identity_lookup
from quillspark.operators.ranking import numbered
from quillspark.runtime import materialize


def upsert_sources(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(paper_id, source, key, url, body): stored rows, of equal (paper_id, source, key) those of ``new`` instead, with the stored
    url or body where the new one is null."""
    keys = ["paper_id", "source", "key"]
    n = new.groupBy(*keys).agg(F.max("url").alias("nu"), F.max("body").alias("nb"), F.lit(True).alias("there"))
    return stored.join(n, keys, "full").select(*keys, F.coalesce("nu", "url").alias("url"), F.coalesce("nb", "body").alias("body"))


def backfill(papers: DataFrame, identifiers: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(paper_id, kind, value): identifiers that papers have by their columns and the identifier table lacks. Nothing is written:
    the caller appends the rows, or only counts them."""
    found = papers.select(F.col("id").alias("paper_id"), F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in kinds.items()]))).where("value is not null")
    return found.distinct().join(identifiers.select("paper_id", "kind", "value"), ["paper_id", "kind", "value"], "left_anti")


def ingest(papers: DataFrame, records: DataFrame, rules: dict[str, Column], clean) -> dict[str, DataFrame]:
    """Tables new (id, record), merged (id, record), rejected (record, rule), edges (source, target) and counts (what, n).

    Records (external_id, doi, title, references, ...) are validated; of valid ones with the same strongest key the first by
    external id, title and DOI counts, and the references of all. A record that shares a key with a stored paper is merged into it, the others get ids after
    the largest. References that name a stored or new paper become edges, once each and not to itself.
    """
    ok = F.lit(True)
    for rule in rules.values():
        ok = ok & F.coalesce(rule, F.lit(False))
    r = materialize(records.withColumn("record", F.xxhash64(F.coalesce("external_id", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("doi", F.lit("")))), "ingest-records")
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), None).otherwise(F.lit(n)) for n, c in rules.items()]))
    rejected = r.select("record", F.explode(broken).alias("rule")).distinct()
    key = identity_keys(F.col("external_id"), F.col("doi"), F.col("title"))[0]
    valid = r.where(ok).withColumn("key", key).where("key is not null")
    order = F.struct("external_id", "title", "doi", "record")
    first = materialize(valid.groupBy("key").agg(F.min_by(F.struct("record", "external_id", "doi", "title"), order).alias("x")).select("key", "x.*"), "ingest-valid")
    met = materialize(identity_lookup(first, "record", papers.select("id", "external_id", "doi", "title"), "id").select("record", F.col("target").alias("id")), "ingest-matches")
    merged = met.where("id is not null").select("id", "record")
    last = papers.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    fresh = numbered(met.where("id is null").select("record"), "record").crossJoin(F.broadcast(last)).select((F.col("last") + F.col("number") + 1).alias("id"), "record")
    ids = materialize(fresh.unionByName(merged), "ingest-ids")
    named = papers.select(F.col("id"), clean(F.col("external_id")).alias("ref")).unionByName(first.join(ids, "record").select("id", clean(F.col("external_id")).alias("ref"))).where("ref <> ''")
    named = named.groupBy("ref").agg(F.min("id").alias("target"))
    every = valid.select("key", F.explode("references").alias("ref")).distinct()
    refs = every.join(first.select("key", "record"), "key").join(ids, "record").select(F.col("id").alias("source"), "ref").select("source", clean(F.col("ref")).alias("ref")).where("ref <> ''").distinct()
    edges = materialize(refs.join(named, "ref").where("source <> target").select("source", "target").distinct(), "ingest-edges")
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    counts = count(r, "records").unionByName(count(rejected.select("record").distinct(), "rejected")).unionByName(count(fresh, "inserted")).unionByName(count(merged, "merged")).unionByName(count(edges, "edges"))
    return {"new": fresh, "merged": merged, "rejected": rejected, "edges": edges, "counts": counts}


def dataset_status(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: papers, with abstract, embeddable sources, edges, first and last year, last update; ready if there are papers."""
    p = papers.agg(F.count(F.lit(1)).alias("papers"), F.sum((F.trim(F.coalesce("abstract", F.lit(""))) != "").cast("int")).alias("with_abstract"), F.countDistinct("source").alias("sources"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.max("updated_at").alias("updated"))
    return p.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges")))).withColumn("ready", F.col("papers") > 0)


def health(spark: SparkSession) -> DataFrame:
    """One row that says that the session answers."""
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(spark.version).alias("engine"))


def work_filter(kind: str | None = None, years: tuple[int, int] | None = None, citations: int | None = None, topics: list[str] | None = None) -> Column:
    """Condition on catalogue works (type, publication_year, cited_by_count, topics); what is not given does not count."""
    parts = []
    if kind:
        parts.append(F.col("type") == kind)
    if years:
        parts.append(F.col("publication_year").between(*years))
    if citations is not None:
        parts.append(F.col("cited_by_count") >= citations)
    if topics:
        parts.append(F.exists("topics", lambda t: F.lower(t).isin([x.lower() for x in topics])))
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def text_location(arxiv: Column, urls: Column, allowed, open_url: Column) -> Column:
    """Where the text of a paper may be read, by the first way that there is: its arXiv PDF, an allowed address, an open copy."""
    first = lambda kind, c: F.when(c.isNotNull(), F.struct(F.lit(kind).alias("kind"), c.alias("url")))
    return F.coalesce(first("arxiv", F.concat(F.lit("https://arxiv.org/pdf/"), arxiv)), first("direct", F.try_element_at(F.filter(urls, allowed), F.lit(1))), first("open", open_url))

