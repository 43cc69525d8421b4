"""Feature tables of candidates: ranks and scores of several methods, text and metadata, and what is missing in them.

Runs are long rows (query_id, doc, method, score, rank); rank or score may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import overlap_shares, phrase_hit, plain_tokens
from quillspark.operators.ranking import ranked, top_k

#: Value of a rank that is not there.
NO_RANK = 999.0


def wide_runs(runs: DataFrame, methods: list[str]) -> DataFrame:
    """(query_id, doc, <m>_rank, <m>_score ...): one row per candidate of any method."""
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}_{c}")
    return runs.groupBy("query_id", "doc").agg(*[pick(m, c) for m in methods for c in ("rank", "score")])


def method_features(runs: DataFrame, methods: list[str], lexical: list[str], vector: list[str]) -> DataFrame:
    """Seven features of each method (rank and score there or not, rank, reciprocal rank, score, score between the query's ends,
    and in its population deviations), and of all: counts, best, mean and spread of ranks, and how far the best lexical and
    the best vector rank are apart. Missing ranks count 999, missing scores 0."""
    w = Window.partitionBy("query_id", "method")
    s = F.col("score")
    lo, hi, sd = F.min(s).over(w), F.max(s).over(w), F.stddev_pop(s).over(w)
    r = runs.withColumns({"minmax": F.when(hi > lo, (s - lo) / (hi - lo)).otherwise(0.0), "z": F.when(sd > 0, (s - F.avg(s).over(w)) / sd).otherwise(0.0)})
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    wide = r.groupBy("query_id", "doc").agg(*[pick(m, c).alias(f"_{m}_{c}") for m in methods for c in ("rank", "score", "minmax", "z")])
    out = {}
    for m in methods:
        rank, score = F.col(f"_{m}_rank"), F.col(f"_{m}_score")
        zero = lambda c, there=score: F.when(there.isNotNull(), F.coalesce(c, F.lit(0.0))).otherwise(0.0)
        out |= {
            f"{m}_rank_present": rank.isNotNull().cast("double"), f"{m}_rank": F.coalesce(rank.cast("double"), F.lit(NO_RANK)), f"{m}_reciprocal_rank": F.coalesce(1.0 / F.greatest(rank, F.lit(1)), F.lit(0.0)),
            f"{m}_score_present": score.isNotNull().cast("double"), f"{m}_score_raw": zero(score), f"{m}_score_minmax": zero(F.col(f"_{m}_minmax")), f"{m}_score_z": zero(F.col(f"_{m}_z")),
        }
    there = F.array_compact(F.array(*[F.col(f"_{m}_rank").cast("double") for m in methods]))
    n = F.size(there)
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / n
    best = lambda ms: F.coalesce(F.array_min(F.array_compact(F.array(*[F.col(f"_{m}_rank").cast("double") for m in ms]))), F.lit(NO_RANK))
    out |= {
        "rank_method_count": n.cast("double"), "score_method_count": F.size(F.array_compact(F.array(*[F.col(f"_{m}_score") for m in methods]))).cast("double"), "best_rank": best(methods),
        "mean_rank": F.when(n > 0, mean).otherwise(NO_RANK), "mean_reciprocal_rank": F.when(n > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + 1.0 / F.greatest(x, F.lit(1.0))) / n).otherwise(0.0),
        "rank_std": F.when(n > 0, F.sqrt(F.aggregate(there, F.lit(0.0), lambda a, x: a + x * x) / n - mean * mean + 1e-15)).otherwise(0.0),
        "lexical_best_rank": best(lexical), "vector_best_rank": best(vector), "lexical_vector_rank_gap": best(lexical) - best(vector),
    }
    return wide.select("query_id", "doc", *[c.alias(k) for k, c in out.items()])


def text_features(pairs: DataFrame, now: int) -> DataFrame:
    """Overlap, length and metadata features of rows (query_id, doc, query, title, abstract, year, citation_count, venue, authors,
    sources (array), external_id, doi, source_url, pdf_url, full_text, title_copies)."""
    empty = F.lit("")
    title, abstract = F.coalesce("title", empty), F.coalesce("abstract", empty)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    filled = lambda c: flag(F.coalesce(F.col(c), empty) != "")
    t, a = overlap_shares(F.col("query"), title), overlap_shares(F.col("query"), abstract)
    size = lambda c: F.size(plain_tokens(c)).cast("double")
    year, id_ = F.coalesce(F.col("year").cast("double"), F.lit(0.0)), F.lower(F.coalesce("external_id", empty))
    out = {
        "query_title_overlap_count": t["overlap"].cast("double"), "query_title_overlap_query_ratio": t["of_query"], "query_title_overlap_title_ratio": t["of_text"],
        "query_abstract_overlap_count": a["overlap"].cast("double"), "query_abstract_overlap_query_ratio": a["of_query"], "query_abstract_overlap_abstract_ratio": a["of_text"],
        "query_phrase_in_title": flag(phrase_hit(F.col("query"), title)), "query_phrase_in_abstract": flag(phrase_hit(F.col("query"), abstract)),
        "title_char_length": F.length(title).cast("double"), "abstract_char_length": F.length(abstract).cast("double"), "title_token_length": size(title), "abstract_token_length": size(abstract),
        "abstract_missing": flag(F.trim(abstract) == ""), "abstract_short": flag((size(abstract) > 0) & (size(abstract) < 40)), "year": year, "paper_age": F.when(year > 0, F.greatest(now - year, F.lit(0.0))).otherwise(0.0),
        "log_citation_count": F.log1p(F.greatest(F.coalesce("citation_count", F.lit(0)), F.lit(0))), "venue_present": filled("venue"), "author_count": F.greatest(F.size("authors"), F.lit(0)).cast("double"),
        "source_count": F.size("sources").cast("double"), **{f"source_{s}": flag(F.array_contains("sources", s)) for s in ("arxiv", "openalex", "seed")},
        "has_arxiv_id": flag(id_.startswith("arxiv:")), "has_doi": filled("doi"), "has_openalex_id": flag(id_.startswith("openalex:")), "has_source_url": filled("source_url"), "has_pdf_url": filled("pdf_url"), "fulltext_available": flag(F.col("full_text")),
        "evidence_title_abstract": flag(~F.coalesce("full_text", F.lit(False)) & (F.trim(abstract) != "")), "evidence_title_abstract_intro_conclusion": flag(F.col("full_text")),
        "duplicate_title_cluster_present": flag(F.col("title_copies") > 1), "duplicate_title_cluster_size": F.col("title_copies").cast("double"), "normalized_title_duplicate": flag(F.col("query_copies") > 1),
    }
    return pairs.select("query_id", "doc", *[c.alias(k) for k, c in out.items()])


def target_ranks(scores: DataFrame, targets: DataFrame, absent: int) -> DataFrame:
    """Target pairs with their rank in a full ranking and the score by the query's maximum; what the ranking lacks has rank
    ``absent`` and score 0."""
    top = F.max(F.greatest("score", F.lit(0.0))).over(Window.partitionBy("query_id"))
    r = ranked(scores, "query_id").withColumn("normal", F.when(top > 0, F.greatest("score", F.lit(0.0)) / top).otherwise(0.0))
    return targets.join(r.select("query_id", "doc", "rank", "normal"), ["query_id", "doc"], "left").withColumns({"rank": F.coalesce("rank", F.lit(absent)), "normal": F.coalesce("normal", F.lit(0.0))})


def with_fallback(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The best k of the first run for the queries that it answers, of the second run for the others."""
    a = top_k(first, "query_id", k).select("query_id", "doc", "score")
    b = top_k(second, "query_id", k).select("query_id", "doc", "score")
    return a.unionByName(b.join(a.select("query_id").distinct(), "query_id", "left_anti"))


def feature_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """(query_id, doc, features, missing, digest): values as an array (missing ones 0), the names of what is missing, and a SHA-256
    of both, so that two builds can be compared."""
    value = lambda n: F.col(n).cast("double") if n in df.columns else F.lit(None).cast("double")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    cells = F.array(*[F.when(odd(value(n)), 0.0).otherwise(value(n)) for n in names])
    missing = F.array_compact(F.array(*[F.when(odd(value(n)), n) for n in names]))
    text = F.concat_ws("|", F.array_join(F.transform(cells, lambda x: F.round(x * 1_000_000).cast("bigint").cast("string")), ","), F.array_join(missing, ","))
    return df.select("query_id", "doc", cells.alias("features"), missing.alias("missing"), F.sha2(text, 256).alias("digest"))


def feature_coverage(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, rows, there, nonzero, share): one pass over all features."""
    parts = [F.struct(F.lit(n).alias("feature"), F.count(F.lit(1)).alias("rows"), F.count(n).alias("there"), F.sum((F.coalesce(F.col(n).cast("double"), F.lit(0.0)) != 0).cast("int")).alias("nonzero"), F.avg(F.col(n).isNotNull().cast("double")).alias("share")) for n in names]
    return df.agg(*[p.alias(f"_{i}") for i, p in enumerate(parts)]).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(parts))])))


def direction_audit(df: DataFrame, label: str, expected: dict[str, int]) -> DataFrame:
    """(feature, r, expected, odd): correlation of each feature with the label against its expected sign; odd from 0.05 the
    wrong way."""
    one = df.agg(*[F.corr(F.col(n).cast("double"), F.col(label).cast("double")).alias(n) for n in expected])
    r = lambda n: F.coalesce(F.when(~F.isnan(n), F.col(n)), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), r(n).alias("r"), F.lit(s).alias("expected")) for n, s in expected.items()])
    return one.select(F.inline(rows)).withColumn("odd", F.col("r") * F.col("expected") <= -0.05)


def coefficient_audit(model: dict, expected: dict[str, int], spark) -> DataFrame:
    """(feature, coefficient, expected, suspicious): coefficients of a fitted linear model whose sign is not the expected one."""
    rows = [(n, round(float(model["coefficients"][n]), 9), s, model["coefficients"][n] * s < 0) for n, s in expected.items()]
    return spark.createDataFrame(rows, "feature string, coefficient double, expected int, suspicious boolean")


def refined(base: Column, fused: Column, disagreement: Column, confidence: Column, weak: Column) -> dict[str, Column]:
    """Careful mixes of a base score and a fused one: their difference capped, used only where the base is not confident, less
    where a third score disagrees, lowered for rows with a bad pattern (``weak``), and plain mixes."""
    diff = fused - base
    cap = lambda c: base + F.greatest(F.least(diff, F.lit(c)), F.lit(-c))
    out = {f"cap_{c}": cap(c) for c in (0.01, 0.02, 0.03)}
    out |= {f"gate_{c}": F.when(confidence >= c, base).otherwise(0.8 * base + 0.2 * fused) for c in (0.85, 0.90)}
    out |= {f"doubt_{c}": base + F.when(F.abs(disagreement) > c, 0.05).otherwise(0.20) * diff for c in (0.25, 0.35)}
    out["pattern"] = cap(0.025) - F.when(weak, 0.04).otherwise(0.0)
    out |= {f"mix_{int(w * 100)}": (1 - w) * base + w * fused for w in (0.10, 0.20, 0.30, 0.50)}
    return out


def inventory(df: DataFrame, maps: list[str], lists: list[str]) -> DataFrame:
    """(field, item, rows): keys of map columns and elements of array columns, with the rows that have them."""
    parts = [df.select(F.lit(m).alias("field"), F.explode(F.map_keys(m)).alias("item")) for m in maps]
    parts += [df.select(F.lit(c).alias("field"), F.explode(F.array_distinct(F.col(c).cast("array<string>"))).alias("item")) for c in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("field", "item").agg(F.count(F.lit(1)).alias("rows"))
