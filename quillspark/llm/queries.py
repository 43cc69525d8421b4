"""The training-data queries, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.contamination import contaminated
from quillspark.llm.grouped_splits import assign_splits, linked_rows, torn_groups
from quillspark.llm.languages import document_languages, document_segments, fit_models, unnamed_languages
from quillspark.llm.matching import assign_one_to_one, match_records
from quillspark.llm.names import entity_classes, variant_pairs
from quillspark.llm.near_duplicates import near_duplicate_classes, near_duplicate_pairs
from quillspark.llm.oracle import SQL  # noqa: F401
from quillspark.llm.overlap import cross_split_overlaps, overlap_report, split_name
from quillspark.llm.tokens import encode_corpus
from quillspark.llm.vectors import nearest
from quillspark.operators.joins import skew_join
from quillspark.runtime import load, materialize, spread


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cross_split_overlaps(load(spark, d, "training_examples"), "example_id", "split", "positive_paper_id", "query_text")
    return pairs.select(F.least("train_id", "eval_id").alias("example_id_a"), F.greatest("train_id", "eval_id").alias("example_id_b"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    report = overlap_report(load(spark, d, "training_examples"), "example_id", "split", "label_source", "positive_paper_id", "query_text")
    return report.withColumn("most_contained", F.round("most_contained", 6))


def _paper_texts(spark: SparkSession, d: str) -> DataFrame:
    papers = load(spark, d, "papers")
    return papers.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))).alias("text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicate_pairs(_paper_texts(spark, d), "id", "text", n=3, similarity=0.5)
    return pairs.select(F.col("id_a").alias("paper_id_a"), F.col("id_b").alias("paper_id_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_classes(_paper_texts(spark, d), "id", "text")


def _linked_examples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(rows with clean split, their groups): query ids join rows only when they name a manual query."""
    rows = load(spark, d, "training_examples").select("example_id", "query_paper_id", split_name("split").alias("split"), F.lower(F.trim("query_id")).alias("query"))
    known = load(spark, d, "manual_queries").select(F.lower(F.trim("query_id")).alias("query")).distinct().withColumn("known", F.col("query"))
    rows = materialize(skew_join(rows, known, "query"), "examples")
    return rows, linked_rows(rows, "example_id", "query_paper_id", "known")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows, groups = _linked_examples(spark, d)
    return torn_groups(groups, rows, "example_id", "split")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    _, groups = _linked_examples(spark, d)
    return assign_splits(groups, "example_id", {"train": 0.8, "val": 0.1, "test": 0.1})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(load(spark, d, "paper_vectors"), "document_id", "embedding", 128)
    return near.select(F.least("id", "other").alias("document_id_a"), F.greatest("id", "other").alias("document_id_b")).distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(spread(load(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "ids")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return contaminated(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(load(spark, d, "documents").select("doc_id", "text", "lang"))
    return unnamed_languages(docs, "doc_id", "text", "lang", fit_models(docs, "doc_id", "text", "lang"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(load(spark, d, "documents").select("doc_id", "text", "lang"))
    return document_segments(docs, "doc_id", "text", fit_models(docs, "doc_id", "text", "lang")).withColumnRenamed("key", "doc_id")


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(load(spark, d, "documents").select("doc_id", "text", "lang"))
    return document_languages(docs, "doc_id", "text", fit_models(docs, "doc_id", "text", "lang"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_pairs(load(spark, d, "papers").select("authors"), "authors")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with the smallest spelling of its person or organisation, and how many it has."""
    return entity_classes(load(spark, d, "papers").select("authors"), "authors")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    papers = load(spark, d, "papers").select("id", "title", F.array_join("authors", "; ").alias("authors"), "year", "doi")
    records = load(spark, d, "harvest_records").select(F.col("record_id").alias("id"), "title", "authors", "year", "doi")
    return match_records(papers, records)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("paper_id", "record_id")


def p5_assigned(spark: SparkSession, d: str) -> DataFrame:
    return assign_one_to_one(_matches(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_classes, p3_found, p3_classes, p4_found, p4_splits, p5_found, p5_assigned, p6_found, p8_ids, p9_found, p10_found, p10_segments, p10_languages)}
