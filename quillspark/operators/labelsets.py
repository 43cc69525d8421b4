"""Sets of labelled pairs: preference pairs, set comparisons, exact joins, checks and summaries of labels.

Label rows are (query_id, doc, reading, topic, bucket, negative, role, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.labels import pair_kind

KEY = ["query_id", "doc"]


def preference_pairs(labels: DataFrame, most: int) -> DataFrame:
    """(query_id, preferred, rejected, kind): pairs of a positive and a weaker or hard-negative document of one query. The
    positives come by bucket, reading and id, and so do the rejects of each; the first ``most`` of a query are kept, for which
    no more than ``most`` + 1 rejects of a positive and as many positives can be needed."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bucket"), F.desc("reading"), "doc")
    o = labels.select(*KEY, "bucket", "reading", F.coalesce("negative", F.lit(False)).alias("negative")).withColumn("at", F.row_number().over(order))
    good = o.where("bucket >= 1").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most + 1).select("query_id", *[F.col(c).alias(f"a_{c}") for c in ("doc", "bucket", "reading", "at")])
    # a positive may skip only rejects that are as good as itself; those come before its own bucket ends
    bad = o.where("bucket <= 1 or negative").select("query_id", *[F.col(c).alias(f"b_{c}") for c in ("doc", "bucket", "reading", "negative", "at")])
    met = good.join(bad, "query_id").where("a_doc <> b_doc and not (a_bucket <= b_bucket and a_reading <= b_reading)")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("a_at", "b_at"))
    return met.withColumn("r", place).where(F.col("r") <= most).select("query_id", F.col("a_doc").alias("preferred"), F.col("b_doc").alias("rejected"), pair_kind(F.col("a_bucket"), F.col("b_bucket"), F.col("b_negative")).alias("kind"))


def set_comparison(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(side, keys): every key of either side as both, left or right; the symmetric difference is what is not both."""
    l, r = left.select(*keys).distinct().withColumn("l", F.lit(1)), right.select(*keys).distinct().withColumn("r", F.lit(1))
    return l.join(r, keys, "full").select(F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both").alias("side"), *keys)


def exact_join(parts: dict[str, DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, missing): rows of all tables with equal keys, and for every key that a table lacks its name; nothing is dropped
    in silence."""
    names = list(parts)
    marked = [df.withColumn(f"_{n}", F.lit(True)) for n, df in parts.items()]
    whole = reduce(lambda a, b: a.join(b, keys, "full"), marked)
    lacks = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), n) for n in names]))
    flags = [f"_{n}" for n in names]
    return whole.where(F.size(lacks) == 0).drop(*flags), whole.where(F.size(lacks) > 0).select(*keys, F.explode(lacks).alias("lacks"))


def outside(overrides: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of overrides that no candidate has: empty if the overrides may be used."""
    return overrides.select(*keys).distinct().join(candidates.select(*keys).distinct(), keys, "left_anti")


def label_checks(labels: DataFrame, hard: dict[str, Column], soft: dict[str, Column], known: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, level, rule): broken rules as errors and warnings; with ``known``, labels that are there already; with
    ``wanted``, candidates without a label."""
    rule = lambda level, rules: F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(n).alias("rule"))) for n, ok in rules.items()])
    out = labels.select(*KEY, F.explode(F.array_compact(F.concat(rule("error", hard), rule("warning", soft)))).alias("x")).select(*KEY, "x.level", "x.rule")
    note = lambda df, level, name: df.select(*KEY, F.lit(level).alias("level"), F.lit(name).alias("rule"))
    copies = labels.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = out.unionByName(note(copies, "error", "repeated"))
    if known is not None:
        out = out.unionByName(note(labels.join(known.select(*KEY).distinct(), KEY, "left_semi"), "error", "known already"))
    if wanted is not None:
        out = out.unionByName(note(outside(wanted, labels, KEY), "warning", "not labelled"))
    return out


def topic_profile(labels: DataFrame) -> DataFrame:
    """One row per query: counts, shares and mean scores of its labels, and whether it has fewer than the middle query. The
    middle is the place n // 2 of the sorted counts."""
    by = labels.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("bucket") == b).cast("int")).alias(f"bucket_{b}") for b in (0, 1, 2)], F.sum(F.col("negative").cast("int")).alias("negatives"),
        F.avg("reading").alias("reading"), F.avg("topic").alias("topic"), F.countDistinct("role").alias("roles"), F.avg(F.col("negative").cast("double")).alias("negative_share"),
    )
    counts = by.groupBy("n").agg(F.count(F.lit(1)).alias("queries"))  # no more rows than there are different counts
    upto = F.sum("queries").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    middle = counts.withColumn("upto", upto).crossJoin(F.broadcast(by.agg(F.floor(F.count(F.lit(1)) / 2).alias("half")))).where("upto > half").agg(F.min("n").alias("middle"))
    return by.crossJoin(F.broadcast(middle)).withColumn("sparse", F.col("n") < F.col("middle")).drop("middle")


def distribution(labels: DataFrame, group: str | None, columns: list[str]) -> DataFrame:
    """(group, field, value, n): how often each value of each column stands, per group or over all rows."""
    g = F.col(group) if group else F.lit("all")
    return labels.select(g.alias("group"), F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))).groupBy("group", "field", "value").agg(F.count(F.lit(1)).alias("n"))


def sufficiency(labels: DataFrame, scopes: list[str], least: int, negatives: int) -> DataFrame:
    """(scope, name, n, negatives, missing): scopes are columns whose values are looked at one by one, and all rows together;
    missing names what is too few."""
    each = F.array(F.struct(F.lit("all").alias("scope"), F.lit("all").alias("name")), *[F.struct(F.lit(s).alias("scope"), F.col(s).cast("string").alias("name")) for s in scopes])
    by = labels.select("bucket", "negative", F.inline(each)).where("name is not null").groupBy("scope", "name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("negative").cast("int")).alias("negatives"), *[F.sum((F.col("bucket") == b).cast("int")).alias(f"b{b}") for b in (0, 1, 2)]
    )
    lacks = F.array_compact(F.array(F.when(F.col("n") < least, "rows"), F.when(F.col("negatives") < negatives, "negatives"), *[F.when(F.col(f"b{b}") == 0, f"bucket {b}") for b in (0, 1, 2)]))
    return by.select("scope", "name", "n", "negatives", F.array_join(lacks, ",").alias("missing"))


def progress(candidates: DataFrame, labels: DataFrame, group: str) -> DataFrame:
    """(group, candidates, labelled, remaining, share): a group without labels has 0, one without candidates does not count."""
    c = candidates.groupBy(group).agg(F.countDistinct("doc").alias("candidates"))
    l = labels.join(candidates.select(*KEY).distinct(), KEY, "left_semi").groupBy(group).agg(F.countDistinct("doc").alias("labelled"))
    n = F.coalesce("labelled", F.lit(0))
    return c.join(l, group, "left").select(group, "candidates", n.alias("labelled"), F.greatest(F.col("candidates") - n, F.lit(0)).alias("remaining"), (n / F.col("candidates")).alias("share"))


def common_label(df: DataFrame, names: dict[str, str], defaults: dict[str, str], version: str) -> DataFrame:
    """Labels of one version in common columns: ``names`` maps common to own names, missing columns come from ``defaults`` (SQL)."""
    own = [F.col(names.get(c, c)).alias(c) if names.get(c, c) in df.columns else F.expr(v).alias(c) for c, v in defaults.items()]
    return df.select(*KEY, *own, F.lit(version).alias("version"))


def unjudged(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    return candidates.join(labels.select(*KEY).distinct(), KEY, "left_anti")


def topic_priority(losses: DataFrame, test_topics: list[str]) -> DataFrame:
    """(query_id, priority): from (query_id, loss), one for each and ten times the loss up to one more, and 0.75 for topics of
    the test split."""
    w = F.sum(1.0 + F.least(F.lit(1.0), 10.0 * F.abs("loss"))) + F.when(F.col("query_id").isin(test_topics), 0.75).otherwise(0.0)
    return losses.groupBy("query_id").agg(w.alias("priority"))


def repeated_titles(df: DataFrame, title: Column) -> DataFrame:
    """Adds repeated: whether another row of the query has the same title; blank titles never do."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", "_t"))
    return df.withColumn("_t", title).withColumn("repeated", (F.coalesce("_t", F.lit("")) != "") & (n > 1)).drop("_t")
