"""The catalog of core queries and of the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import queries_corpus, queries_diagnostics, queries_evaluation, queries_integrity, queries_labels, queries_learning, queries_retrieval, queries_selection, queries_sources

MODULES = [queries_retrieval, queries_evaluation, queries_corpus, queries_integrity, queries_learning, queries_labels, queries_diagnostics, queries_selection, queries_sources]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return queries()["hybrid_batch"](spark, d)
