"""Typed readers of record files, with bad rows kept apart, and the projections of two public record formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import normal_doi, normal_openalex, union_lists

#: Schema of ingest records as they stand in JSON lines.
RECORD_SCHEMA = (
    "external_id string, source string, doi string, title string, abstract string, authors array<string>, year int, venue string, categories array<string>, citation_count int, "
    "influential_citation_count int, url string, source_url string, references array<string>"
)
#: Schema of a work as the works interface of a scholarly catalogue gives it.
WORK_SCHEMA = (
    "id string, doi string, title string, publication_year int, cited_by_count int, abstract_inverted_index map<string, array<int>>, authorships array<struct<author: struct<display_name: string>>>, "
    "topics array<struct<display_name: string>>, keywords array<struct<display_name: string>>, referenced_works array<string>, type string"
)


def read_json_lines(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): rows of the schema, and bad with file and text of every line that is no JSON object of it. Blank lines
    are skipped. Nothing is inferred, so one pass reads the files."""
    raw = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    bad = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), "value").withColumn("ok", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return raw.where("_bad is null").drop("_bad"), bad.where("ok is null or ok._bad is not null").select("file", "value")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV file with a header; quoted line breaks are part of a field."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_records(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Rows of a .jsonl, .json, .csv or .parquet path; another ending is an error."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end in ("jsonl", "json"):
        return read_json_lines(spark, path, schema)[0]
    if end == "csv":
        return read_csv(spark, path, schema)
    if end == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{end}")


def read_harvest_xml(spark: SparkSession, path: str) -> DataFrame:
    """Papers of harvested XML records: id, title and abstract are required, deleted records are left out."""
    schema = "header struct<_status: string, identifier: string>, metadata struct<arXiv: struct<id: string, title: string, abstract: string, created: string, categories: string, authors: struct<author: array<struct<keyname: string, forenames: string, suffix: string>>>>>"
    raw = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", "true").schema(schema).load(path)
    a = raw.where("header._status is null or header._status <> 'deleted'").select("metadata.arXiv.*")
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    name = lambda x: F.concat_ws(" ", F.trim(x["forenames"]), F.trim(x["keyname"]), F.trim(x["suffix"]))
    return a.where("id is not null and title is not null and abstract is not null").select(
        F.concat(F.lit("arxiv:"), F.trim("id")).alias("external_id"), F.lit("arxiv").alias("source"), squeeze("title").alias("title"), squeeze("abstract").alias("abstract"),
        F.transform("authors.author", name).alias("authors"), F.substring("created", 1, 4).cast("int").alias("year"), F.split(F.trim("categories"), r"\s+").alias("categories"),
    )


def inverted_abstract(index: Column) -> Column:
    """Text of an inverted index from words to positions, words by position; null stays null."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


def works_to_records(works: DataFrame) -> DataFrame:
    """Catalogue works as ingest records; works without title or abstract are left out."""
    names = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<display_name: string>>")), lambda x: x["display_name"])
    return works.select(
        F.concat(F.lit("openalex:"), normal_openalex(F.col("id"))).alias("external_id"), F.lit("openalex").alias("source"), normal_doi(F.col("doi")).alias("doi"), F.col("title"),
        inverted_abstract(F.col("abstract_inverted_index")).alias("abstract"), F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("publication_year").alias("year"),
        F.col("cited_by_count").alias("citation_count"), union_lists(names(F.col("topics")), names(F.col("keywords"))).alias("categories"), F.transform("referenced_works", lambda r: F.concat(F.lit("openalex:"), normal_openalex(r))).alias("references"),
    ).where("trim(title) <> '' and trim(abstract) <> ''")
