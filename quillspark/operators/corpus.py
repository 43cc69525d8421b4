"""Identity, merging, graph, split, selection and validation operators over record tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import identity_keys, normal_title
from quillspark.operators.near_titles import near_title_links
from quillspark.operators.ranking import numbered
from quillspark.runtime import materialize

#: Linked records that a task folds together, besides those of its largest block.
FOLDED = 20_000

# --- identity ----------------------------------------------------------------------------------------------------------


def duplicate_groups(df: DataFrame, key: Column, row: str, examples: int = 5) -> DataFrame:
    """(key, n, first_rows): keys with more than one row, and their ``examples`` smallest row ids. Blank and null keys form
    no group. The ids kept per key are bounded before they are gathered."""
    rows = df.select(key.alias("key"), F.col(row).alias("row")).where("key is not null and key <> ''")
    n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("row"))).where(F.col("r") <= examples)
    return n.join(first.groupBy("key").agg(F.sort_array(F.collect_list("row")).alias("first_rows")), "key")


def identity_lookup(records: DataFrame, row: str, targets: DataFrame, target: str) -> DataFrame:
    """(row, target, key): the target that shares a record's strongest key (external id, then DOI, then title); of several
    targets with one key the smallest id counts. Both sides have external_id, doi and title. Records without a match have
    null. Keys are hashed out on both sides and joined by equality."""
    keyed = lambda df, c: df.select(F.col(c).alias("i"), F.posexplode(identity_keys(F.col("external_id"), F.col("doi"), F.col("title"))).alias("strength", "key"))
    known = keyed(targets, target).groupBy("key").agg(F.min("i").alias("target"))
    hit = keyed(records, row).join(known, "key").groupBy("i").agg(F.min_by(F.struct("target", "key"), "strength").alias("m"))
    return records.select(F.col(row).alias("i")).distinct().join(hit, "i", "left").select(F.col("i").alias(row), F.col("m.target").alias("target"), F.col("m.key").alias("key"))


def resolve_references(records: DataFrame, key: Column, refs: Column, clean) -> DataFrame:
    """(source, reference, target, kind): each reference of each record with the record that it names. kind is edge, self,
    repeated (of references to one target, all after the first) or missing. ``clean`` brings keys and references to one
    spelling; blank references are left out."""
    known = records.select(clean(key).alias("ref")).where("ref <> ''").distinct()
    out = records.select(clean(key).alias("source"), F.posexplode(refs).alias("pos", "reference")).withColumn("ref", clean(F.col("reference"))).where("ref <> ''").distinct()
    met = out.join(known.withColumn("there", F.lit(True)), "ref", "left")
    first = F.row_number().over(Window.partitionBy("source", "ref").orderBy("pos", "reference"))
    kind = F.when(F.col("there").isNull(), "missing").when(F.col("ref") == F.col("source"), "self").when(F.col("r") > 1, "repeated").otherwise("edge")
    return met.withColumn("r", first).select("source", "reference", F.when(F.col("there"), F.col("ref")).alias("target"), kind.alias("kind"))


def completeness() -> Column:
    """How many of the fields title, abstract, authors, year, venue, categories, counts and ids are filled, plus bounded
    bonuses for a long abstract and many citations."""
    text = [F.coalesce(F.trim(c), F.lit("")) != "" for c in ("title", "abstract", "venue", "external_id", "source", "doi", "url", "source_url")]
    lists = [F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0 for c in ("authors", "categories")]
    numbers = [F.coalesce(c, F.lit(0)) != 0 for c in ("year", "citation_count", "influential_citation_count")]
    filled = sum((b.cast("double") for b in [*text, *lists, *numbers]), F.lit(0.0))
    return filled + F.least(F.length(F.coalesce("abstract", F.lit(""))) / 1000.0, F.lit(1.0)) + F.least(F.greatest(F.coalesce("citation_count", F.lit(0)), F.lit(0)) / 1000.0, F.lit(1.0))


def merge_records(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the fullest record (ties to the earlier) with its gaps filled from the others in that order, the
    longest abstract and the largest counts. Aggregates combine before the shuffle."""
    rank = F.struct((-completeness()).alias("c"), F.col(order).alias("o"))
    best = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), rank))
    long = F.struct((-F.length("abstract")).alias("l"), rank.alias("r"))
    return df.groupBy(key).agg(
        *[best(c).alias(c) for c in ("title", "venue", "doi", "url", "year")],
        F.min_by("abstract", F.when(F.col("abstract").isNotNull(), long)).alias("abstract"),
        *[F.max(F.coalesce(c, F.lit(0))).alias(c) for c in ("citation_count", "influential_citation_count")],
        F.count(F.lit(1)).alias("records"),
    )


def fold_duplicates(records: DataFrame, row: str, least: float = 0.92) -> DataFrame:
    """(row, kept): the earlier record that each is merged into, itself if it is new. Order counts: rows are taken by id,
    each joins the record that owns its first known key (external id, DOI, title), else the earliest kept record whose title
    is near its own, and the keys of a merged record are then owned by the record that it joined. A kept record keeps its
    own title. Records with no key in common and no near title cannot meet, so the fold runs per block of rows that keys and
    near titles connect; a block holds the copies of one work. A task folds many blocks."""
    keyed = materialize(records.select(F.col(row).alias("row"), normal_title(F.col("title")).alias("t"), F.posexplode(identity_keys(F.col("external_id"), F.col("doi"), F.col("title"))).alias("strength", "key")), "record-keys")
    links = near_title_links(keyed.where("t is not null").select("t"), least)
    tie = F.concat(F.lit("near:"), "a", F.lit("|"), "b")  # a key of both titles, which connects but is not owned
    met = links.select(F.inline(F.array(*[F.struct(F.col(x).alias("t"), F.col(y).alias("other"), (F.col(s) >= least).alias("ok"), tie.alias("key")) for x, y, s in (("a", "b", "ab"), ("b", "a", "ba"))])))
    near = keyed.select("row", "t").distinct().join(met, "t").select("row", "t", F.lit(9).alias("strength"), "key", "other", "ok")
    keyed = materialize(keyed.select("row", "t", "strength", "key", F.lit(None).cast("string").alias("other"), F.lit(False).alias("ok")).unionByName(near), "record-links")
    # a record that shares no key is kept as it is, so only the others are put into blocks and folded
    shared = keyed.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("key")
    linked = materialize(keyed.join(shared, "key", "left_semi"), "shared-keys")
    block = linked.groupBy("row").agg(F.min("row").alias("block"))
    settled = False
    while not settled:  # blocks only ever fall, so this ends
        low = linked.join(block, "row").groupBy("key").agg(F.min("block").alias("low"))
        after = materialize(linked.join(low, "key").groupBy("row").agg(F.min("low").alias("block")), "record-blocks")
        settled = after.join(block.withColumnRenamed("block", "was"), "row").where("block <> was").isEmpty()
        block = after

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        """Any number of whole blocks: keys and near titles of different blocks never meet."""
        owner, titled, out = {}, {}, []
        group = group.sort_values(["row", "strength"])
        rows = zip(group["row"], group["t"], group["key"], group["other"], group["ok"], group["other"].isna())
        for r, part in itertools.groupby(rows, key=lambda x: x[0]):
            part = list(part)
            keys = [key for _, _, key, _, _, owned in part if owned]
            kept = next((owner[k] for k in keys if k in owner), None)
            if kept is None:
                kept = min((titled[other] for _, _, _, other, ok, _ in part if ok and other in titled), default=r)
            if kept == r:
                titled[part[0][1]] = r
            owner.update(dict.fromkeys(keys, kept))
            out.append((r, kept))
        return pd.DataFrame(out, columns=["row", "kept"])

    buckets = max(12, -(-block.count() // FOLDED))
    bucket = F.pmod(F.xxhash64("block"), F.lit(buckets)).alias("bucket")
    found = linked.join(block, "row").select("row", "t", "strength", "key", "other", "ok", bucket).groupBy("bucket").applyInPandas(fold, "row bigint, kept bigint")
    return records.select(F.col(row).alias("row")).distinct().join(found, "row", "left").select(F.col("row").alias(row), F.coalesce("kept", "row").alias("kept"))


def near_titles(df: DataFrame, row: str, title: str, least: float = 0.92) -> DataFrame:
    """(row_a, row_b, similarity) of different normalised titles of 20 letters or more whose word overlap or matching-block
    ratio reaches ``least``, each title by its smallest row. No pair is left out."""
    t = materialize(df.select(F.col(row).alias("row"), normal_title(F.col(title)).alias("t")).where("t is not null").groupBy("t").agg(F.min("row").alias("row")), "title-rows")
    at = lambda c: t.select(F.col("t").alias(c), F.col("row").alias(f"row_of_{c}"))
    met = near_title_links(t, least).join(at("a"), "a").join(at("b"), "b")
    first = F.col("row_of_a") < F.col("row_of_b")
    out = met.select(F.least("row_of_a", "row_of_b").alias("row_a"), F.greatest("row_of_a", "row_of_b").alias("row_b"), F.when(first, F.col("ab")).otherwise(F.col("ba")).alias("similarity"))
    return out.where(F.col("similarity") >= least)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: insert or update by key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def override(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows whose key is not overridden, and all overriding rows."""
    return base.join(over.select(*keys).distinct(), keys, "left_anti").unionByName(over, allowMissingColumns=True)


def repoint(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges (source, target) after merging: ``moved`` has (old, new); self and repeated edges fall away."""
    m = moved.select("old", "new")
    out = edges.join(m.toDF("source", "_s"), "source", "left").join(m.toDF("target", "_t"), "target", "left")
    return out.select(F.coalesce("_s", "source").alias("source"), F.coalesce("_t", "target").alias("target")).where("source <> target").distinct()


# --- graph -------------------------------------------------------------------------------------------------------------


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (source, target) with both ends among ``nodes`` (id) and no self edge."""
    e = edges.where("source is not null and target is not null and source <> target").select("source", "target").distinct()
    ids = nodes.select("id").distinct()
    return e.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")


def neighbours(edges: DataFrame, most: int) -> DataFrame:
    """(node, degree, first_neighbours): neighbours in either direction; only the ``most`` smallest are gathered."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"))).distinct()
    degree = both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    first = both.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("other"))).where(F.col("r") <= most)
    return degree.join(first.groupBy("node").agg(F.sort_array(F.collect_list("other")).alias("first_neighbours")), "node")


def weak_labels(edges: DataFrame, nodes: DataFrame, least: int, most: int) -> DataFrame:
    """(query_id, query, relevant): for nodes with at least ``least`` neighbours, their title as a query in three templates
    and the ``most`` smallest neighbours as relevant."""
    near = neighbours(edges, most).where(F.col("degree") >= least)
    titled = near.join(nodes.select(F.col("id").alias("node"), "title"), "node").where("trim(title) <> ''")
    forms = F.array(*[F.struct(F.lit(k).alias("form"), F.concat(F.lit(head), F.col("title")).alias("query")) for k, head in enumerate(("", "papers related to ", "background reading for "))])
    return titled.select("node", F.inline(forms), F.col("first_neighbours").alias("relevant")).select(F.concat_ws("-", "node", "form").alias("query_id"), "query", "relevant")


# --- splits and samples ------------------------------------------------------------------------------------------------


def hash_share(seed: int, key: Column) -> Column:
    """A number from 0 to 1 from the SHA-256 of seed and key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967295.0


def hash_split(seed: int, key: Column, train: float = 0.8, val: float = 0.1) -> Column:
    u = hash_share(seed, key)
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def ordinal_split(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds split by the place in the group: of ten rows seven train, one val, two test."""
    at = (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) % 10
    return df.withColumn("split", F.when(at < 7, "train").when(at < 8, "val").otherwise("test"))


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): whole groups dealt out in order of their name."""
    names = df.select(group).where(F.col(group).isNotNull()).distinct()
    return numbered(names, group).select(group, (F.col("number") % folds).cast("int").alias("fold"))


def paired_folds(df: DataFrame, group: str, weight: Column) -> DataFrame:
    """(fold, first, second): groups ordered by weight, the lightest paired with the heaviest and so on inwards."""
    w = df.groupBy(group).agg(F.sum(weight).alias("w")).where(F.col(group).isNotNull())
    at = materialize(numbered(w, "w", group).select(group, (F.col("number") + 1).cast("int").alias("fold")), "weighed-groups")
    n = at.count()
    second = at.select((n + 1 - F.col("fold")).cast("int").alias("fold"), F.col(group).alias("second"))
    return at.withColumnRenamed(group, "first").join(second, "fold").where(F.col("fold") * 2 <= n + 1).select("fold", "first", "second")


def triplets(df: DataFrame, seed: int, most: int) -> DataFrame:
    """(query, positive, negative): negatives of each row unfolded, at most ``most`` per query in hash order."""
    t = df.select("query", "positive", F.explode("negatives").alias("negative")).where("negative is not null and negative <> positive").distinct()
    order = Window.partitionBy("query").orderBy(hash_share(seed, F.concat_ws(":", "query", "positive", "negative")), "positive", "negative")
    return t.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def balanced_sample(df: DataFrame, label: str, key: Column, seed: int, size: int, share: float) -> DataFrame:
    """``size`` rows in hash order with a share of positives; what one side lacks the other fills."""
    n = df.agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((~F.col(label)).cast("long")).alias("n"))
    want = F.lit(round(size * share))
    p = F.least(F.greatest(want, F.lit(size) - F.col("n")), F.col("p"))
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(hash_share(seed, key), key))).crossJoin(F.broadcast(n.withColumn("p", p).withColumn("n", F.least(F.lit(size) - F.col("p"), F.col("n")))))
    return r.where(F.col("_r") <= F.when(F.col(label), F.col("p")).otherwise(F.col("n"))).select(df.columns)


#: Documents in one arc of the ring of :func:`negatives_by_hash`, on average.
ARC_DOCS = 64


def ring_place(seed: int, key: Column) -> Column:
    """A place from 0 to 2**32 - 1 from the SHA-256 of seed and key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint")


def negatives_by_hash(queries: DataFrame, docs: DataFrame, taken: DataFrame, seed: int, k: int) -> DataFrame:
    """(query, doc): k pseudo-random documents per query that are not taken, or all free ones if they are fewer. Documents
    and queries have places on a ring; a query gets the free documents that follow its own place. The ring is cut into arcs;
    queries that do not find enough in their next arcs look further, until the whole ring is seen, so none is short."""
    ring = 1 << 32
    arcs = max(1, docs.count() // ARC_DOCS)
    size = -(-ring // arcs)
    placed = materialize(docs.select("doc").distinct().withColumn("at", ring_place(seed, F.col("doc"))).withColumn("arc", F.floor(F.col("at") / size)), "ring-documents")
    rest = materialize(queries.select("query").distinct().withColumn("from", ring_place(seed + 1, F.col("query"))), "ring-queries")
    reach, out = max(2, -(-2 * k // ARC_DOCS) + 1), None
    while not rest.isEmpty():
        whole = reach > arcs
        steps = rest.select("query", "from", F.explode(F.sequence(F.lit(0), F.lit(min(reach, arcs) - 1))).alias("step"))
        near = steps.withColumn("arc", F.pmod(F.floor(F.col("from") / size) + F.col("step"), F.lit(arcs))).join(placed, "arc")
        near = near.withColumn("far", F.pmod(F.col("at") - F.col("from"), F.lit(ring)))
        if not whole:
            near = near.where(F.col("far") < (reach - 1) * size)
        free = near.join(taken.select("query", "doc").distinct(), ["query", "doc"], "left_anti")
        best = free.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("far", "doc"))).where(F.col("r") <= k)
        best = materialize(best.select("query", "doc", F.max("r").over(Window.partitionBy("query")).alias("n")), "ring-negatives")
        done = best if whole else best.where(F.col("n") == k)
        out = done.select("query", "doc") if out is None else out.unionByName(done.select("query", "doc"))
        if whole:
            break
        rest = materialize(rest.join(done.select("query").distinct(), "query", "left_anti"), "ring-queries")
        reach *= 4
    return out if out is not None else taken.select("query", "doc").limit(0)


def quota_selection(df: DataFrame, group: str, quotas: dict[str, int], size: int) -> DataFrame:
    """Greedy selection per group: in order, up to its quota of rows with each reason, then the rest by score until
    ``size``; each row once. Rows have (group, row, score, reasons array). Only the best rows that any step could take
    leave the group: per reason the quota plus what earlier steps may take."""
    reach = size + sum(quotas.values())
    best = Window.partitionBy(group).orderBy(F.desc("score"), "row")
    per = [F.sum(F.when(F.array_contains("reasons", r), 1).otherwise(0)).over(best.rowsBetween(Window.unboundedPreceding, 0)) for r in quotas]
    near = F.row_number().over(best) <= reach
    for r, p in zip(quotas, per):
        near = near | (F.array_contains("reasons", r) & (p <= reach))
    kept = df.withColumn("_near", near).where("_near").drop("_near")

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "row"], ascending=[False, True])
        out, used = [], set()
        for reason, quota in [*quotas.items(), ("fill", size)]:
            for row, reasons in zip(g["row"], g["reasons"]):
                if quota <= 0 or len(out) >= size:
                    break
                if row not in used and (reason == "fill" or reason in set(reasons)):
                    used.add(row)
                    out.append((g[group].iloc[0], row, reason, len(out) + 1))
                    quota -= 1
        return pd.DataFrame(out, columns=[group, "row", "picked_for", "place"])

    kind = dict(df.dtypes)[group]
    return kept.select(group, "row", "score", "reasons").groupBy(group).applyInPandas(pick, f"{group} {kind}, row bigint, picked_for string, place int")


def size_batches(df: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """Adds batch: rows of a group in order, a new batch where the running size would pass ``most``; larger rows stand alone.
    A group's batches follow from each other, so its rows stream through one task, which holds a running size only."""

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, total = object(), 0, 0
        for g in parts:
            out = []
            for name, s in zip(g[group], g[size]):
                if name != now:
                    now, batch, total = name, 0, 0
                if total and total + s > most:
                    batch, total = batch + 1, 0
                total += s
                out.append(batch)
            yield g.assign(batch=out)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", batch int"
    return df.repartition(group).sortWithinPartitions(group, order).mapInPandas(fill, schema)


# --- validation --------------------------------------------------------------------------------------------------------


def violations(df: DataFrame, row: str, rules: dict[str, Column]) -> DataFrame:
    """(row, rule): every rule that a row breaks; a rule that gives null counts as broken."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(row), F.explode(found).alias("rule"))


def missing_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, nulls, blanks, filled, distinct): one pass over all columns."""
    parts = []
    for c in columns:
        s = F.col(c).cast("string")
        parts.append(F.struct(F.lit(c).alias("field"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.sum((F.trim(s) == "").cast("long")).alias("blanks"), F.sum((F.col(c).isNotNull() & (F.trim(s) != "")).cast("long")).alias("filled"), F.countDistinct(s).alias("distinct")))
    one = df.agg(*[p.alias(f"_{i}") for i, p in enumerate(parts)])
    return one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(parts))])))


def split_leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split, with how many."""
    return df.where(F.col(group).isNotNull() & F.col(split).isNotNull()).groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def forbidden_columns(df: DataFrame, forbidden: list[str]) -> list[str]:
    """Columns that a model must not see and that ``df`` has."""
    return sorted(set(df.columns) & set(forbidden))


def row_hash(df: DataFrame) -> DataFrame:
    """(n, digest): count and order-free hash of all rows."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))
