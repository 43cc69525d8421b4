"""What readers did and want: feedback folded into profiles, libraries, personal scores, and planned reading lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.signals import SECTION_LEAST, SECTION_WEIGHTS, SECTIONS, weighted
from quillspark.functions.text import identity_keys, normal_tags, normal_title, plain_tokens
from quillspark.operators.near_titles import near_title_links
from quillspark.runtime import materialize, ship_package, small_enough, spread

#: The profile list that each action adds to.
ACTION_LISTS = {"save": "saved", "more_like_this": "saved", "already_read": "skipped", "not_relevant": "skipped", "less_like_this": "skipped", "too_easy": "too_easy", "too_hard": "too_hard"}
#: Title similarity from which two candidates count as near duplicates.
NEAR_TITLE = 0.92
#: List entries that a block of documents meets at once.
MEMBERS = 512
FIGURES = ["user", "doc", "saved_similarity", "skipped_similarity", "saved", "skipped"]
LISTS = ["saved", "skipped", "too_easy", "too_hard"]


def profile_fold(events: DataFrame) -> DataFrame:
    """(user, saved, skipped, too_easy, too_hard, level, events): events (user, item, action, level, ts) folded per user;
    lists are sorted and distinct, the level is the latest that is not null. Unknown actions only count."""
    target = reduce(lambda acc, kv: acc.when(F.col("action") == kv[0], kv[1]), ACTION_LISTS.items(), F.when(F.lit(False), ""))
    e = events.withColumn("_l", target)
    return e.groupBy("user").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("_l") == name, F.col("item")))).alias(name) for name in LISTS],
        F.max_by("level", F.when(F.col("level").isNotNull(), F.struct("ts", "item"))).alias("level"),
        F.count(F.lit(1)).alias("events"),
    )


def action_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("users"))


def patch(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the fields that a change gives replaced; null fields of a change leave the old value."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in changes.columns if x != key])
    out = current.join(c, key, "left")
    return out.select(*[F.coalesce(f"_{x}", x).alias(x) if f"_{x}" in c.columns else F.col(x) for x in current.columns])


def library(events: DataFrame, tag: str | None = None) -> DataFrame:
    """(user, item, tags, updated): saved items, the latest save's time and all tags in order; one tag if asked for."""
    saved = events.where("action = 'save'").withColumn("tags", normal_tags(F.col("tags")))
    by = saved.groupBy("user", "item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.max("ts").alias("updated"))
    return by if tag is None else by.where(F.array_contains("tags", tag.strip().lower()))


def personal_scores(docs: DataFrame, profile: DataFrame, level: str = "basic_ml") -> DataFrame:
    """(user, doc, score, saved_similarity, skipped_similarity): how well documents (doc, title, abstract) suit users.

    Word overlap with a user's saved and skipped documents raises and lowers a score, being one of them does so more; the
    sum stays between -0.45 and 0.25. Pairs without a common word and without a list entry are left out. The listed
    documents are broadcast; beyond the bound the overlaps come from an inverted index of their words.
    """
    tokens = docs.select("doc", F.array_distinct(plain_tokens(F.concat_ws(" ", "title", "abstract"), 3)).alias("t"))
    listed = profile.select("user", F.inline(F.array(*[F.struct(F.lit(name).alias("list"), F.col(name).alias("items")) for name in ("saved", "skipped")]))).select("user", "list", F.explode("items").alias("item")).distinct()
    listed = materialize(listed, "listed-items")
    hashed = tokens.where(F.size("t") > 0).select("doc", F.transform("t", lambda w: F.xxhash64(w)).alias("t"))
    items = materialize(listed.select(F.col("item").alias("doc")).distinct().join(hashed, "doc"), "listed-words")
    rows = items.agg(F.coalesce(F.sum(F.size("t")), F.lit(0))).first()[0]
    by = _by_blocks(hashed, listed, items) if small_enough(rows + listed.count(), 32) else _by_words(tokens, listed)
    total = 0.10 * F.col("saved") + 0.12 * F.col("saved_similarity") - 0.30 * F.col("skipped") - 0.12 * F.col("skipped_similarity")
    return by.select("user", "doc", F.greatest(F.least(total, F.lit(0.25)), F.lit(-0.45)).alias("score"), "saved_similarity", "skipped_similarity")


def _by_words(tokens: DataFrame, listed: DataFrame) -> DataFrame:
    """(user, doc, similarities and list entries) by an inverted index of the listed documents' words."""
    words = tokens.select("doc", F.explode("t").alias("w"))
    size = words.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    near = listed.select("item").distinct().join(words.withColumnRenamed("doc", "item"), "item").join(words, "w").groupBy("item", "doc").agg(F.count(F.lit(1)).alias("both"))
    near = near.join(size, "doc").join(size.toDF("item", "m"), "item").select("item", "doc", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("s"))
    return listed.join(near, "item").groupBy("user", "doc").agg(
        *[F.coalesce(F.max(F.when(F.col("list") == name, F.col("s"))), F.lit(0.0)).alias(f"{name}_similarity") for name in ("saved", "skipped")],
        *[F.max(((F.col("list") == name) & (F.col("item") == F.col("doc"))).cast("int")).alias(name) for name in ("saved", "skipped")],
    )


def _by_blocks(hashed: DataFrame, listed: DataFrame, items: DataFrame) -> DataFrame:
    """The same as :func:`_by_words`: every document meets the broadcast listed ones where it is read, and only its figures per
    user leave the task, so that no pair of documents is shuffled. Words are compared by their 64-bit hashes."""
    session = hashed.sparkSession
    ship_package(session)
    known = items.orderBy("doc").toArrow()
    ids = known.column("doc").to_numpy()
    flat, sizes = known.column("t").combine_chunks(), np.diff(known.column("t").combine_chunks().offsets.to_numpy())
    vocabulary, word = np.unique(flat.flatten().to_numpy(), return_inverse=True)
    kind = dict(listed.dtypes)["user"]
    member = listed.join(items.select(F.col("doc").alias("item")), "item", "left_semi").orderBy("user", "list", "item").toArrow()
    user = member.column("user").combine_chunks()
    code = np.cumsum(np.r_[0, user.slice(1).to_numpy(zero_copy_only=False) != user.slice(0, max(0, len(user) - 1)).to_numpy(zero_copy_only=False)]) if len(user) else np.zeros(0, np.int64)
    skipped = (member.column("list").to_numpy() == "skipped").astype(np.int64)
    item = np.searchsorted(ids, member.column("item").to_numpy())
    shared = session.sparkContext.broadcast((ids, np.r_[0, np.cumsum(sizes)], word, vocabulary, user, code, skipped, item))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, word, vocabulary, user, code, skipped, item = shared.value
        edges = np.r_[np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), len(code)] if len(code) else np.zeros(1, np.int64)
        cuts = [0]  # users of about MEMBERS entries together
        for e in edges[1:]:
            if e - cuts[-1] >= MEMBERS or e == len(code):
                cuts.append(int(e))
        for b in batches:
            doc, t = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            offsets, n = t.offsets.to_numpy() - t.offsets[0].as_py(), np.diff(t.offsets.to_numpy())
            terms = t.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(vocabulary, terms), max(0, len(vocabulary) - 1))
            at = np.where(vocabulary[at] == terms, at, len(vocabulary)) if len(vocabulary) else np.zeros(len(terms), np.int64)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                some, own = np.unique(item[lo:hi], return_inverse=True)
                holds = np.zeros((len(vocabulary) + 1, len(some)), np.int16)
                for i, x in enumerate(some):
                    holds[word[starts[x] : starts[x + 1]], i] = 1
                group = 2 * code[lo:hi] + skipped[lo:hi]
                first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                who = code[lo:hi][first] - code[lo]
                users = code[hi - 1] - code[lo] + 1
                for f in range(0, len(doc), 128):
                    g = min(len(doc), f + 128)
                    both = np.add.reduceat(holds[at[offsets[f] : offsets[g]]], offsets[f:g] - offsets[f], axis=0).astype(np.int64)
                    s = both / (n[f:g, None] + (starts[some + 1] - starts[some])[None, :] - both)
                    near = np.maximum.reduceat(s[:, own], first, axis=1)
                    same = np.maximum.reduceat((ids[some][own][None, :] == doc[f:g, None]), first, axis=1)
                    sim, entry = np.zeros((2, g - f, users)), np.zeros((2, g - f, users), np.int32)
                    for k in (0, 1):
                        mine = group[first] % 2 == k
                        sim[k][:, who[mine]], entry[k][:, who[mine]] = near[:, mine], same[:, mine]
                    d, u = np.nonzero(sim.max(axis=0) > 0)
                    if len(d):
                        name = user.take(pa.array(np.searchsorted(code, u + code[lo])))
                        yield pa.RecordBatch.from_arrays([name, pa.array(doc[f:g][d]), pa.array(sim[0][d, u]), pa.array(sim[1][d, u]), pa.array(entry[0][d, u]), pa.array(entry[1][d, u])], FIGURES)

    return spread(hashed).mapInArrow(run, f"user {kind}, doc bigint, saved_similarity double, skipped_similarity double, saved int, skipped int")


def duplicate_penalties(candidates: DataFrame) -> DataFrame:
    """(query_id, doc, duplicate): 0.75 for a candidate that shares an id, DOI or title with a better one of its query, else
    0.35 for one whose title is near that of a better one.

    The better one has the higher score plus bounded bonuses for citations and age. Candidates have external_id, doi,
    title, score, year and citation_count. One window per shared key instead of pairs: all but the best of a key are hit. Near
    titles meet the best of each title; where the ratio depends on which candidate comes first, they meet all.
    """
    cites = F.least(F.log1p(F.coalesce("citation_count", F.lit(0))) / 8.0, F.lit(1.5))
    older = F.greatest(F.lit(0.0), (2030 - F.coalesce("year", F.lit(9999))) / 100.0)
    every = materialize(candidates.select("query_id", "doc", (F.col("score") + cites + older).alias("q"), normal_title(F.col("title")).alias("t"), "external_id", "doi", "title"), "duplicate-candidates")
    c = every.select("query_id", "doc", "q", F.explode(identity_keys(F.col("external_id"), F.col("doi"), F.col("title"))).alias("key"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("q"), "doc")))
    shared = r.groupBy("query_id", "doc").agg(F.max(F.when(F.col("r") > 1, 0.75).otherwise(0.0)).alias("duplicate"))
    links = near_title_links(every.where("t is not null").select("t"), NEAR_TITLE)
    ways = links.select(F.inline(F.array(*[F.struct(F.col(x).alias("t"), F.col(y).alias("ot"), (F.col(s) >= NEAR_TITLE).alias("first"), (F.col(z) >= NEAR_TITLE).alias("second")) for x, y, s, z in (("a", "b", "ab", "ba"), ("b", "a", "ba", "ab"))])))
    mine = every.select("query_id", "doc", "q", "t").join(ways, "t")
    others = every.select("query_id", F.col("doc").alias("od"), F.col("q").alias("oq"), F.col("t").alias("ot"))
    best = others.groupBy("query_id", "ot").agg(F.max(F.struct("oq", (-F.col("od")).alias("m"))).alias("b")).select("query_id", "ot", F.col("b.oq").alias("oq"), (-F.col("b.m")).alias("od"))
    worse = (F.col("oq") > F.col("q")) | ((F.col("oq") == F.col("q")) & (F.col("od") < F.col("doc")))
    both = mine.where("first and second").join(best, ["query_id", "ot"]).where(worse)
    one = mine.where("not (first and second)").join(others, ["query_id", "ot"]).where(worse & F.when(F.col("doc") < F.col("od"), F.col("first")).otherwise(F.col("second")))
    near = both.select("query_id", "doc").unionByName(one.select("query_id", "doc")).distinct().withColumn("near", F.lit(0.35))
    return shared.join(near, ["query_id", "doc"], "left").select("query_id", "doc", F.greatest("duplicate", F.coalesce("near", F.lit(0.0))).alias("duplicate"))


def section_scores(candidates: DataFrame, personal: Column | None = None) -> DataFrame:
    """(query_id, doc, section, score, recency): every candidate with signals, scored for each section."""
    extra = personal if personal is not None else F.lit(0.0)
    parts = F.array(*[F.struct(F.lit(s).alias("section"), (weighted(SECTION_WEIGHTS[s]) + extra).alias("section_score")) for s in SECTIONS])
    return candidates.select("query_id", "doc", "recency", F.inline(parts))


def reading_path(scored: DataFrame, per_section: int = 4) -> DataFrame:
    """(query_id, section, place, doc, section_score): sections are filled in order with their best documents above the
    section's least score, each document once per query; the frontier takes recent ones only. Four rank-and-remove steps."""
    scored = materialize(scored, "section-scores")  # read by every step
    used, out = None, None
    for s in SECTIONS:
        c = scored.where((F.col("section") == s) & (F.col("section_score") >= SECTION_LEAST[s]))
        if s == "recent_frontier":
            c = c.where("recency >= 0.35")
        if used is not None:
            c = c.join(used, ["query_id", "doc"], "left_anti")
        w = Window.partitionBy("query_id").orderBy(F.desc("section_score"), "doc")
        best = materialize(c.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_section).select("query_id", "section", "place", "doc", "section_score"), "section-papers")
        out = best if out is None else out.unionByName(best)
        ids = best.select("query_id", "doc")
        used = ids if used is None else used.unionByName(ids)
    return out
