"""Flags, reasons, labels and excerpts of papers and judgements, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.signals import holds_any
from quillspark.functions.text import plain_tokens, word_tokens

#: Words whose presence gives a reason to add a paper for the variety of its role.
ROLE_REASONS = {
    "role_diversity_survey_background": ["survey", "review", "overview", "taxonomy"],
    "role_diversity_evaluation_benchmark": ["benchmark", "evaluation", "dataset", "metric"],
    "role_diversity_application": ["application", "case study", "deployed", "real-world"],
    "role_diversity_foundational": ["foundation", "foundational", "seminal", "first "],
}
#: Abstracts that say nothing, and the length under which one is too short to judge by.
VAGUE, VAGUE_LENGTH = ["no abstract", "abstract not available", "not available", "none", "n/a"], 50
#: Sections of a reading path and how they are shown.
SECTION_NAMES = {"background": "Background", "foundational": "Foundational", "core_methods": "Core Methods", "recent_frontier": "Recent Frontier"}
#: Background levels that a reader may name.
LEVELS = ["basic_ml", "intermediate", "advanced"]
#: Headings that are known without a number.
HEADINGS = ["abstract", "introduction", "1 introduction", "1. introduction", "related work", "method", "methods", "experiments", "results", "discussion", "conclusion", "conclusions", "references"]


def _text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def _kept(*flags: Column) -> Column:
    return F.array_compact(F.array(*flags))


def generic_survey(title: Column, abstract: Column) -> Column:
    """Whether a paper is a survey by its title, or says so in its abstract."""
    return holds_any(_text(title), ["survey", "review", "overview"]) | holds_any(_text(abstract), ["we survey", "this survey"])


def vague_abstract(abstract: Column) -> Column:
    """Whether an abstract, white space collapsed, is too short or says that there is none. Null is vague."""
    flat = F.lower(F.trim(F.regexp_replace(F.coalesce(abstract, F.lit("")), r"\s+", " ")))
    return (F.length(flat) < VAGUE_LENGTH) | flat.isin(VAGUE)


def allowed_pdf(url: Column) -> Column:
    """Whether an address leads to a PDF that may be fetched: https, and a host and path that are known for it."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#]+)", 1))
    path = F.lower(F.regexp_extract(url, r"^https://[^/?#]+([^?#]*)", 1))
    known = F.when(host.endswith("arxiv.org"), path.startswith("/pdf/")).when((host == "openreview.net") & (path == "/pdf"), True).otherwise(path.endswith(".pdf"))
    return F.coalesce((host != "") & known, F.lit(False))


def shares_token(title: Column, terms: list[str]) -> Column:
    """Whether a title has one of the terms as a whole word."""
    return F.arrays_overlap(plain_tokens(F.coalesce(title, F.lit(""))), F.array(*[F.lit(t) for t in terms]))


def lexicon_hits(text: Column, terms: Column) -> Column:
    """The terms of a topic's list that stand in the text, in the order of the list."""
    return F.filter(terms, lambda t: F.contains(text, t))


def role_reasons(title: Column, abstract: Column) -> Column:
    text = _text(title, abstract)
    return _kept(*[F.when(holds_any(text, terms), reason) for reason, terms in ROLE_REASONS.items()])


def coverage_guess(title: Column, year: Column, citations: Column, overlap: Column, reasons: Column) -> Column:
    """Likely use of a candidate for a topic, by the first rule that holds."""
    has = lambda r: F.array_contains(reasons, r)
    cited, about = F.coalesce(citations, F.lit(0)), holds_any(_text(title), ["survey", "taxonomy", "overview", "benchmark", "evaluation"])
    core, back, new, bad = "likely core/foundational positive", "likely relevant survey/background", "likely recent frontier/application", "likely hard negative"
    return (
        F.when(has("random_weak_negative"), "likely random/irrelevant negative").when(has("canonical_foundational_seed"), core).when(about & (overlap >= 1), back)
        .when((cited >= 1000) & (overlap >= 1), core).when((year >= 2022) & (overlap >= 2), new).when((overlap >= 3) & (cited >= 100), core)
        .when((overlap >= 2) & (year >= 2018), new).when(overlap >= 2, back).otherwise(bad)
    )


def provenance(source: Column, *others: Column) -> Column:
    """Where a paper came from, by its ids and addresses: the two known catalogues first, then its own source; else unknown."""
    text = _text(source, *others)
    found = _kept(F.when(F.contains(text, F.lit("arxiv")), "arxiv"), F.when(F.contains(text, F.lit("openalex")), "openalex"), F.when(F.coalesce(source, F.lit("")) != "", F.lower(source)))
    return F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(F.array(F.lit("unknown")))


def best_levels(scores: dict[str, Column], joiner: str = "+", none: str = "none") -> Column:
    """Names of the largest score, joined where several are; none if all are 0 or less."""
    values = {k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in scores.items()}
    top = F.greatest(*values.values())
    return F.when(top <= 0, none).otherwise(F.array_join(_kept(*[F.when(c == top, k) for k, c in values.items()]), joiner))


def best_level(scores: dict[str, Column], none: str = "unknown") -> Column:
    """The name of the largest score, ties to the later name; none if all are 0 or less."""
    pairs = F.array(*[F.struct(F.coalesce(c.cast("double"), F.lit(0.0)).alias("v"), F.lit(k).alias("k")) for k, c in scores.items()])
    top = F.array_max(pairs)
    return F.when(top["v"] > 0, top["k"]).otherwise(none)


def positive(reading: Column, topic: Column, least: float = 0.5) -> Column:
    return F.coalesce((reading >= least) & (topic >= 0.5), F.lit(False))


def hidden_positive(reading: Column, topic: Column) -> Column:
    """A strong positive; asked of rows that were not judged at first."""
    return positive(reading, topic, 0.75)


def pair_kind(preferred: Column, rejected: Column, rejected_hard: Column) -> Column:
    """Kind of a preference pair, from the relevance buckets of both sides."""
    return F.when(rejected_hard, "positive_over_hard_negative").when((preferred == 2) & (rejected == 1), "strong_positive_over_partial").when((preferred >= 1) & (rejected == 0), "positive_over_negative").otherwise("positive_over_weak")


def explanation_signals(relevance: Column, citation: Column, recency: Column, fit: Column, background: Column, method: Column, personal: Column, tags: Column) -> Column:
    """Up to seven reasons for a recommendation, in a fixed order, and the first two tags."""
    reasons = _kept(
        F.when(relevance >= 0.65, "strong query match"), F.when(citation >= 6, "strong citation signal"), F.when(recency >= 0.82, "recent paper"), F.when(fit >= 0.8, "fits selected background level"),
        F.when(background >= 0.5, "background-friendly framing"), F.when(method >= 0.5, "method or architecture signal"), F.when(personal > 0, "boosted by profile feedback"),
    )
    return F.slice(F.array_distinct(F.concat(reasons, F.slice(tags, 1, 2))), 1, 7)


def read_before(section: Column) -> Column:
    """Sections to read before the given one, as they are shown."""
    names = list(SECTION_NAMES.values())
    return reduce(lambda acc, kv: acc.when(section == kv[1], F.array(*[F.lit(n) for n in names[: kv[0]]]).cast("array<string>")), enumerate(SECTION_NAMES), F.when(F.lit(False), F.array().cast("array<string>")))


def read_after(section: Column) -> Column:
    names = list(SECTION_NAMES.values())
    return reduce(lambda acc, kv: acc.when(section == kv[1], F.array(*[F.lit(n) for n in names[kv[0] + 1 :]]).cast("array<string>")), enumerate(SECTION_NAMES), F.when(F.lit(False), F.array().cast("array<string>")))


def learned_adjustment(score: Column, learned: Column) -> Column:
    """Base score moved by a quarter of what a learned score differs from one half; without a learned score it stays."""
    return score + F.coalesce(0.25 * (learned - 0.5), F.lit(0.0))


def topic_match(text: Column, topics: Column) -> Column:
    """Largest share of a topic's words (three letters or more) that the text has, over an array of topics; 0 without any."""
    own = F.array_distinct(plain_tokens(text, 3))
    share = F.transform(topics, lambda t: F.size(F.array_intersect(F.array_distinct(plain_tokens(t, 3)), own)) / F.nullif(F.size(F.array_distinct(plain_tokens(t, 3))), F.lit(0)))
    return F.coalesce(F.array_max(share), F.lit(0.0))


def heading_lines(text: Column) -> Column:
    """Distinct lines that are headings: known names, or a number and a capital, up to 120 characters."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(lines, is_heading))


def is_heading(line: Column) -> Column:
    return (line != "") & (F.length(line) <= 120) & (F.lower(line).isin(HEADINGS) | line.rlike(r"^[0-9]+(\.[0-9]+)*\.?\s+[A-Z][A-Za-z0-9 ,:;()/-]{2,}$"))


def named_section(text: Column, names: list[str]) -> Column:
    """Lines after the first heading of one of the names, up to the next heading; null if there is none."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    start = F.array_position(F.transform(lines, lambda x: F.lower(F.trim(x)).isin(names)), True)
    rest = F.slice(lines, (start + 1).cast("int"), F.size(lines))
    stops = F.transform(rest, lambda x, i: F.when((i > 0) & is_heading(F.trim(x)), i))
    end = F.coalesce(F.array_min(stops), F.size(rest))
    return F.when(start > 0, F.nullif(F.trim(F.array_join(F.slice(rest, F.lit(1), end), "\n")), F.lit("")))


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def excerpt_at(text: Column, names: list[str], most: int, before: int = 0) -> Column:
    """Piece of a flat text from the first of the names that stands in it as a word (in the order of the list), beginning
    ``before`` characters earlier; null if none does."""
    low = F.lower(text)
    at = F.coalesce(*[F.nullif(F.regexp_instr(low, F.lit(rf"\b{n}\b")), F.lit(0)) for n in names])
    return F.when(at.isNotNull(), F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(most)))


def best_window(text: Column, terms: Column, width: int) -> Column:
    """Struct (at, hits) of the window of ``width`` characters, beginning half of it before an occurrence of a term, that
    holds the most occurrences of the terms; of equals the first in the order of terms and places. Null without any."""
    low = F.lower(text)

    def places(t: Column) -> Column:
        sizes = F.transform(F.split(low, F.concat(F.lit("\\Q"), t, F.lit("\\E"))), lambda p: F.length(p))
        ends = F.transform(F.sequence(F.lit(1), F.size(sizes) - 1), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, b: a + b) + (i - 1) * F.length(t))
        return F.when(F.size(sizes) > 1, ends).otherwise(F.array().cast("array<int>"))

    starts = F.transform(F.flatten(F.transform(terms, places)), lambda p: F.greatest(p - width // 2, F.lit(0)))
    count = lambda w: F.aggregate(terms, F.lit(0), lambda a, t: a + F.size(F.split(w, F.concat(F.lit("\\Q"), t, F.lit("\\E")))) - 1)
    scored = F.transform(starts, lambda s, i: F.struct(count(F.substring(low, s + 1, F.lit(width))).alias("hits"), (-i).alias("order"), s.alias("at")))
    top = F.array_max(scored)
    return F.when(top["hits"] > 0, F.struct(top["at"].alias("at"), top["hits"].alias("hits")))


def short_abstract(abstract: Column, words: int = 50) -> Column:
    return F.size(word_tokens(F.coalesce(abstract, F.lit("")))) < words
