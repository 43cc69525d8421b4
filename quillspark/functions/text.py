"""Text, identifier, list and number functions as column expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lexical_tokens(c: Column) -> Column:
    """Runs of ASCII letters, digits and underscore, lower case, in order; null gives no tokens."""
    small = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # other letters must stay as they are
    return F.coalesce(F.regexp_extract_all(small, F.lit("[a-z0-9_]+"), 0), F.array().cast("array<string>"))


def plain_tokens(c: Column, least: int = 1) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text with at least ``least`` characters."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{%d,}" % least), 0), F.array().cast("array<string>"))


def word_tokens(c: Column, least: int = 1) -> Column:
    """Runs of letters and digits of any script and underscore, lower case."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{%d,}" % least), 0), F.array().cast("array<string>"))


def word_count(stored: Column, text: Column) -> Column:
    """The stored count unless it is null or 0, else the words of the text."""
    return F.coalesce(F.when(stored != 0, stored), F.size(word_tokens(text)))


def blank_word_count(c: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


def normal_title(c: Column) -> Column:
    """Lower-case letters and digits with single blanks between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normal_id(c: Column) -> Column:
    """Trimmed lower case; blank gives null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def normal_doi(c: Column) -> Column:
    """DOI without its address or tag, lower case; blank gives null."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://doi\.org/|doi:)\s*", "")
    return F.nullif(F.trim(bare), F.lit(""))


def doi_url(c: Column) -> Column:
    """Address of a DOI, its case kept."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"(?i)^(https?://doi\.org/|doi:)", ""))
    return F.when(bare != "", F.concat(F.lit("https://doi.org/"), bare))


_ARXIV = r"([A-Za-z\-]+/[0-9]{7}|[0-9]{4}\.[0-9]{4,5})(v[0-9]+)?"


def arxiv_id(*cs: Column) -> Column:
    """First arXiv id in the given fields, by address, DOI or bare form, lower case and without version; else null."""
    found = []
    for c in cs:
        for before in (r"(?i)arxiv\.org/(?:abs|pdf)/", r"(?i)10\.48550/arxiv\.", r"(?i)^\s*(?:arxiv:)\s*"):
            found.append(F.nullif(F.lower(F.regexp_extract(c, before + _ARXIV, 1)), F.lit("")))
        found.append(F.nullif(F.regexp_extract(F.lower(F.trim(c)), "^" + _ARXIV + "$", 1), F.lit("")))
    return F.coalesce(*found)


def normal_arxiv(c: Column) -> Column:
    """Bare arXiv id: tags, address, .pdf and version taken off, lower case."""
    x = F.trim(c)
    for pattern in (r"(?i)^arxiv:\s*", r"(?i)^10\.48550/arxiv\.", r"(?i)^https?://arxiv\.org/(abs|pdf)/", r"\.pdf$", r"(?i)v[0-9]+$"):
        x = F.regexp_replace(x, pattern, "")
    return F.lower(F.trim(x))


def normal_openalex(c: Column) -> Column:
    """Last part of an OpenAlex address or tag; work ids upper case, others lower."""
    last = F.element_at(F.split(F.regexp_replace(F.trim(c), "/+$", ""), "/"), -1)
    bare = F.trim(F.regexp_replace(last, "(?i)^openalex:", ""))
    return F.when(F.lower(bare).startswith("w"), F.upper(bare)).otherwise(F.lower(bare))


def identity_keys(external_id: Column, doi: Column, title: Column) -> Column:
    """Tagged lookup keys of a record, strongest first, without repeats; missing parts give none."""
    ext, d, t = normal_id(external_id), normal_doi(doi), F.nullif(normal_title(title), F.lit(""))
    keys = [F.concat(F.lit("external_id:"), ext), F.concat(F.lit("doi:"), d), F.concat(F.lit("title:"), t)]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def parse_time(c: Column) -> Column:
    """Timestamp of an ISO date or date-time, Z and offsets understood; anything else gives null."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def year_band(year: Column) -> Column:
    """Label of the period of a year."""
    out = F.when(year.isNull(), "unknown").when(year < 2010, "pre-2010")
    for lo, hi in ((2010, 2014), (2015, 2018), (2019, 2021), (2022, 2023)):
        out = out.when(year <= hi, f"{lo}-{hi}")
    return out.otherwise("2024+")


def snippet(c: Column, most: int = 260) -> Column:
    """White space collapsed; longer texts are cut and end in three points."""
    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("...")))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""), 1, n), " ")


def model_text(query: Column, title: Column, abstract: Column, words: int = 220) -> Column:
    """Text of a query and a document for a text model."""
    return F.concat(F.lit("query: "), F.coalesce(query, F.lit("")), F.lit(" title: "), F.coalesce(title, F.lit("")), F.lit(" abstract: "), first_words(abstract, words))


def split_list(c: Column) -> Column:
    """Parts of a list in one string, separated by semicolons; blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def union_lists(a: Column, b: Column) -> Column:
    """Elements of both lists in order, trimmed, each once without regard to case; the first spelling stays."""
    empty = F.array().cast("array<string>")
    items = F.filter(F.transform(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.aggregate(items, empty, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def normal_tags(c: Column) -> Column:
    """Trimmed lower-case tags in order, each once, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))


def json_ints(c: Column) -> Column:
    """Sorted distinct numbers of a JSON list; what is no list gives the empty one."""
    return F.coalesce(F.array_sort(F.array_distinct(F.from_json(c, "array<bigint>"))), F.array().cast("array<bigint>"))


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Null and NaN give the lower end."""
    return F.least(F.greatest(F.when(F.isnan(c), None).otherwise(F.coalesce(c, F.lit(lo))), F.lit(lo)), F.lit(hi))


def quantise(c: Column) -> Column:
    """0, 0.5 or 1."""
    return F.when(c <= 0.25, 0.0).when(c < 0.75, 0.5).otherwise(1.0)


def reciprocal_rank(c: Column, missing: float = 0.0) -> Column:
    return F.when(c.between(1, 999_998), 1.0 / c).otherwise(F.lit(missing))


def overlap_shares(query: Column, text: Column) -> Column:
    """Struct of the distinct tokens that both share, and their shares of the query's and of the text's."""
    q, t = F.array_distinct(plain_tokens(query)), F.array_distinct(plain_tokens(text))
    both = F.size(F.array_intersect(q, t))
    return F.struct(both.alias("overlap"), (both / F.greatest(F.size(q), F.lit(1))).alias("of_query"), (both / F.greatest(F.size(t), F.lit(1))).alias("of_text"))


def phrase_hit(query: Column, text: Column) -> Column:
    """Whether the normalised query stands in the normalised text; a blank query never does."""
    q = normal_title(query)
    return (q != "") & F.contains(normal_title(text), q)
