"""Scoring signals of a document for a query and a reader, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import normal_title, word_count, word_tokens

#: Word lists whose members are looked for as parts of a lower-cased text.
BACKGROUND_TERMS = ["book", "guide", "handbook", "introduction", "overview", "primer", "review", "survey", "tutorial"]
METHOD_TERMS = ["algorithm", "architecture", "benchmark", "framework", "method", "model", "network", "optimization", "system", "technique", "training"]
NARROW_TERMS = ["case study", "clinical", "dataset", "domain-specific", "drug", "education", "industrial", "materials", "medical", "metal-organic", "molecular", "news", "protein", "single-cell", "usmle"]
BROAD_QUERIES = [
    "agent", "agents", "deep learning", "diffusion model", "diffusion models", "graph neural network", "graph neural networks", "large language model", "large language models",
    "llm", "llms", "recommendation systems", "reinforcement learning", "transformer", "transformers",
]
DOMAIN_QUERIES = [*NARROW_TERMS, "biology", "chemistry", "healthcare", "medicine", "science", "scientific discovery"]
TECHNICAL_TERMS = [
    "attention", "backpropagation", "bayesian", "contrastive", "diffusion", "embedding", "fine-tuning", "graph neural", "in-context", "latent", "optimization", "policy gradient",
    "reinforcement", "representation learning", "transformer", "variational",
]
BEGINNER_TERMS = ["a primer", "beginner", "introduction", "introductory", "overview", "review", "survey", "tutorial"]
#: Tags and the parts of a text that give them.
TYPE_TERMS = {
    "survey": ["survey", "review", "systematic review"], "tutorial": ["tutorial", "primer", "introduction to", "guide"], "book": ["book", "handbook", "monograph"],
    "foundation": ["introduced", "seminal", "foundational"], "method": ["method", "architecture", "algorithm", "model", "framework"],
    "benchmark": ["benchmark", "dataset", "evaluation suite", "leaderboard"], "application": ["application", "case study", "clinical", "medical", "domain-specific"],
    "position/opinion": ["position", "perspective", "opinion", "viewpoint"],
}
SECTIONS = ["background", "foundational", "core_methods", "recent_frontier"]
#: Least score of a section's papers.
SECTION_LEAST = {"background": 0.28, "foundational": 0.24, "core_methods": 0.26, "recent_frontier": 0.30}
#: Weights of the signals in the section scores and in the hybrid score.
SECTION_WEIGHTS = {
    "background": {"relevance": 0.40, "background": 0.34, "fit": 0.18, "citation": 0.06, "duplicate": -1.0, "narrow_penalty": -1.2},
    "foundational": {"relevance": 0.28, "citation": 0.42, "influence": 0.18, "age": 0.18, "generic_narrow": -0.35, "duplicate": -1.0},
    "core_methods": {"relevance": 0.42, "method": 0.28, "fit": 0.12, "citation": 0.10, "narrow_penalty": -0.60, "duplicate": -1.0},
    "recent_frontier": {"relevance": 0.44, "recency": 0.30, "method": 0.10, "citation": 0.08, "background": -0.18, "narrow_penalty": -1.0, "duplicate": -1.0},
}
HYBRID_WEIGHTS = {"relevance": 0.48, "citation": 0.12, "influence": 0.08, "recency": 0.08, "fit": 0.08, "background": 0.07, "method": 0.07, "duplicate": -1.0, "narrow_penalty": -1.0}
RELEVANCE_WEIGHTS = {"bm25": 0.48, "tfidf": 0.22, "dense": 0.30}


def _terms(terms: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


def holds_any(text: Column, terms: list[str]) -> Column:
    return F.exists(_terms(terms), lambda t: F.contains(text, t))


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms stand in the text. A higher-order function keeps the generated code small."""
    return F.size(F.filter(_terms(terms), lambda t: F.contains(text, t)))


def keyword_score(text: Column, terms: list[str]) -> Column:
    return F.least(hits(text, terms) / 2.0, F.lit(1.0))


def citation_score(count: Column) -> Column:
    return F.least(F.log1p(F.greatest(F.coalesce(count, F.lit(0)), F.lit(0))) / 8.0, F.lit(1.0))


def influence_score(count: Column) -> Column:
    return F.least(F.log1p(F.greatest(F.coalesce(count, F.lit(0)), F.lit(0))) / 6.0, F.lit(1.0))


def recency_score(year: Column, now: int) -> Column:
    """Banded by age; a null year gives 0."""
    age = F.greatest(F.lit(now) - year, F.lit(0))
    return F.when(year.isNull(), 0.0).when(age <= 1, 1.0).when(age <= 3, 0.82).when(age <= 5, 0.35).when(age <= 8, 0.18).otherwise(0.05)


def technical_density(text: Column) -> Column:
    words = F.size(word_tokens(text))
    return F.when(words == 0, 0.0).otherwise(hits(F.lower(text), TECHNICAL_TERMS) / words)


def difficulty_score(beginner: Column, words: Column, density: Column, references: Column, citations: Column, year: Column, now: int) -> Column:
    """From 0 to 1, rounded to 3 places: framing, length, terminology, references, age and citations move it from 0.35."""
    cited = F.coalesce(citations, F.lit(0))
    moves = [
        F.when(beginner, -0.24),
        F.when(words >= 350, 0.18).when(words >= 220, 0.10).when(words <= 90, -0.08),
        F.when(density >= 0.025, 0.24).when(density >= 0.012, 0.12),
        F.when(F.coalesce(references, F.lit(0)) >= 80, 0.10),
        F.when((year >= now - 2) & (cited < 50), 0.12),
        F.when(cited >= 1000, -0.08).when(cited >= 200, -0.04),
    ]
    total = reduce(lambda a, b: a + b, [F.coalesce(m, F.lit(0.0)) for m in moves], F.lit(0.35))
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 3)


def difficulty_label(score: Column) -> Column:
    return F.when(score < 0.34, "beginner").when(score < 0.67, "intermediate").otherwise("advanced")


def difficulty_fit(score: Column, level: str) -> Column:
    if level == "advanced":
        return F.lit(1.0)
    if level == "intermediate":
        return 1.0 - F.greatest(score - 0.75, F.lit(0.0))
    return F.when(score < 0.34, 1.0).when(score < 0.67, 0.72).otherwise(0.28)


def generic_factor(query: Column) -> Column:
    """1 for a broad query, 0.85 for a short one that holds a broad term, else 0."""
    q = normal_title(query)
    short = F.size(F.split(q, " ")) <= 3
    return F.when(q.isin(BROAD_QUERIES), 1.0).when(short & holds_any(q, BROAD_QUERIES), 0.85).otherwise(0.0)


def asks_domain(query: Column) -> Column:
    return holds_any(normal_title(query), DOMAIN_QUERIES)


def paper_types(title: Column, abstract: Column, venue: Column, citations: Column, year: Column, now: int) -> Column:
    """Tags of a paper in a fixed order; none gives research."""
    empty = F.lit("")
    text = F.lower(F.concat_ws(" ", F.coalesce(title, empty), F.coalesce(abstract, empty), F.coalesce(venue, empty)))
    tags = []
    for tag, terms in TYPE_TERMS.items():
        rule = holds_any(text, terms)
        tags.append(F.when((F.coalesce(citations, F.lit(0)) >= 1000) | rule if tag == "foundation" else rule, tag))
    tags.append(F.when(year >= now - 3, "frontier"))
    found = F.array_compact(F.array(*tags))
    return F.when(F.size(found) == 0, F.array(F.lit("research"))).otherwise(found)


def relevance(bm25: Column, tfidf: Column, dense: Column) -> Column:
    mixed = RELEVANCE_WEIGHTS["bm25"] * bm25 + RELEVANCE_WEIGHTS["tfidf"] * tfidf + RELEVANCE_WEIGHTS["dense"] * dense
    return F.when(mixed == 0, F.greatest(bm25, tfidf, dense, F.lit(0.0))).otherwise(mixed)


def document_signals(df: DataFrame, now: int) -> DataFrame:
    """Adds the signals that depend on the document alone, to rows with title, abstract, venue, categories (array), year,
    citation_count, references_count, influential_citation_count and abstract_word_count. Every text is built and searched
    once; later columns reuse the results."""
    empty = F.lit("")
    brief = F.lower(F.concat_ws(" ", F.coalesce("title", empty), F.coalesce("abstract", empty)))
    step = df.withColumn("_brief", brief).withColumn("_text", F.concat_ws(" ", "_brief", F.lower(F.coalesce("venue", empty)), F.lower(F.coalesce(F.array_join("categories", "; "), empty))))
    step = step.withColumns(
        {
            "_beginner": holds_any(F.col("_brief"), BEGINNER_TERMS),
            "_words": word_count(F.col("abstract_word_count"), F.col("abstract")),
            "_density": technical_density(F.col("_brief")),
            "citation": citation_score(F.col("citation_count")),
            "influence": influence_score(F.col("influential_citation_count")),
            "recency": recency_score(F.col("year"), now),
            "background": keyword_score(F.col("_text"), BACKGROUND_TERMS),
            "method": keyword_score(F.col("_text"), METHOD_TERMS),
            "narrow": keyword_score(F.col("_text"), NARROW_TERMS),
        }
    )
    hard = difficulty_score(F.col("_beginner"), F.col("_words"), F.col("_density"), F.col("references_count"), F.col("citation_count"), F.col("year"), now)
    return step.withColumn("difficulty", hard).drop("_brief", "_text", "_beginner", "_words", "_density")


def query_signals(df: DataFrame, level: str, duplicate: str | None = None) -> DataFrame:
    """Adds relevance, fit, duplicate and the two narrowness columns to rows with document signals, query, and the scaled
    scores bm25, tfidf and dense."""
    step = df.withColumns({"_generic": generic_factor(F.col("query")), "_domain": asks_domain(F.col("query"))})
    open_ = (F.col("narrow") > 0) & ~F.col("_domain") & (F.greatest("citation", "influence") < 0.78)
    step = step.withColumns(
        {
            "relevance": relevance(F.col("bm25"), F.col("tfidf"), F.col("dense")),
            "fit": difficulty_fit(F.col("difficulty"), level),
            "duplicate": F.col(duplicate) if duplicate else F.lit(0.0),
            "narrow_penalty": F.when(open_, 0.22 * F.col("narrow") * F.col("_generic")).otherwise(0.0),
            "generic_narrow": F.col("narrow") * F.col("_generic"),
        }
    )
    return step.drop("_generic", "_domain")


def weighted(weights: dict[str, float]) -> Column:
    """Sum of the named signal columns; age is one minus recency."""
    return reduce(lambda a, b: a + b, [w * (1.0 - F.col("recency") if name == "age" else F.col(name)) for name, w in weights.items()])


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.72, "high").when(score >= 0.45, "medium").otherwise("low")
