"""The retrieval methods by name, with their explanations, and the checks of what a user may ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.labels import LEVELS
from quillspark.operators import retrieval as R

#: What a method does, in a line for the reader of its results.
EXPLANATIONS = {
    "bm25": "important words of the query stand in title or abstract",
    "tfidf": "weighted words and word pairs of the query stand in title or abstract",
    "citation_recency": "matches the query, with more weight for citations and recent years",
    "dense": "stored vector near the query's vector",
    "hybrid": "lexical, vector and quality signals together",
}
_runs: dict[tuple, DataFrame] = {}


def retrievers() -> dict[str, Callable[..., DataFrame]]:
    """Method name to a function (docs, queries, k) that gives (query_id, doc, score)."""
    return {
        "bm25": lambda docs, queries, k: R.bm25_top(docs, queries, k),
        "tfidf": lambda docs, queries, k: R.tfidf_top(docs, queries, k),
        "citation_recency": lambda docs, queries, k: R.citation_recency_top(docs, queries, k),
        "dense": lambda docs, queries, k: R.dense_search(docs.where("embedding is not null"), queries, k),
        "hybrid": lambda docs, queries, k: R.hybrid(docs, queries, k).select("query_id", "doc", "score"),
    }


def method_name(name: str) -> str:
    """The method that is meant, in lower case without blanks; an unknown one is an error that lists all."""
    found = name.strip().lower()
    if found not in EXPLANATIONS:
        raise ValueError(f"unknown method {name!r}; known: {', '.join(sorted(EXPLANATIONS))}")
    return found


def level_name(name: str) -> str:
    found = name.strip().lower()
    if found not in LEVELS:
        raise ValueError(f"unknown level {name!r}; known: {', '.join(LEVELS)}")
    return found


def recommend(method: str, docs: DataFrame, queries: DataFrame, k: int, signature: str | None = None) -> DataFrame:
    """(method, query_id, doc, score, explanation) of a method by name. With a ``signature`` of corpus and queries the plan of a
    run is kept and given again until the signature changes; the caller may cache it."""
    name = method_name(method)
    key = (id(docs.sparkSession), name, signature, k)
    if signature is None or key not in _runs:
        run = retrievers()[name](docs, queries, k).select(F.lit(name).alias("method"), "query_id", "doc", "score", F.lit(EXPLANATIONS[name]).alias("explanation"))
        if signature is None:
            return run
        for old in [x for x in _runs if x[:2] == key[:2] and x[2] != signature]:
            del _runs[old]
        _runs[key] = run
    return _runs[key]


def methods(spark: SparkSession) -> DataFrame:
    """(method, explanation), by name."""
    return spark.createDataFrame(sorted(EXPLANATIONS.items()), "method string, explanation string")
