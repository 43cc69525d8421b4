"""Whether two tables speak of the same papers, and which of several sources may stand for the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import normal_doi, normal_title


def identity_audit(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """(verdict, n): rows (id, title, year) against the corpus by id: same title, same normalised title and year, another title, or
    no such id; of the last two also how many the corpus has under another id with that title and year."""
    c = corpus.select(F.col("id").alias("cid"), F.col("title").alias("ct"), F.col("year").alias("cy"))
    t = normal_title(F.col("title"))
    other = corpus.select(normal_title(F.col("title")).alias("nt"), F.col("year").alias("ny")).where("nt <> ''").distinct().withColumn("moved", F.lit(True))
    met = rows.withColumn("nt", t).withColumn("ny", F.col("year")).join(c, F.col("id") == F.col("cid"), "left").join(other, ["nt", "ny"], "left")
    moved = F.coalesce("moved", F.lit(False))
    same = F.col("cid").isNotNull() & F.coalesce(F.col("title") == F.col("ct"), F.lit(False))
    near = F.col("cid").isNotNull() & F.coalesce((F.col("nt") == normal_title(F.col("ct"))) & F.col("year").eqNullSafe(F.col("cy")), F.lit(False))
    verdict = F.when(same, "same").when(near, "same but for spelling").when(moved, "under another id").when(F.col("cid").isNull(), "unknown id").otherwise("another title")
    return met.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def alignment_audit(rows: DataFrame, number: str, key: str) -> DataFrame:
    """One row: how many rows have a key equal to their row number, and whether numbers may stand for keys (all are)."""
    one = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col(number) == F.col(key)).cast("int")).alias("aligned"))
    return one.withColumn("safe", (F.col("rows") > 0) & (F.col("rows") == F.col("aligned")))


def source_choice(profiles: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(source, reasons, accepted): why each candidate source is turned down; one without a reason may be taken."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in rules.items()]))
    return profiles.select("source", reasons.alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


def enriched(records: DataFrame, works: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """(record_id, work_id, how, similarity): the catalogue work of each record: by DOI, else the one with the most similar title
    (less 0.1 where the years differ by more than one) if that reaches ``least``. ``links`` is (record title a, work title b,
    similarity) of normalised titles, equal ones excepted. A work that several records get counts for the first; records
    without one have null."""
    r = records.select("record_id", normal_doi(F.col("doi")).alias("doi"), normal_title(F.col("title")).alias("a"), "year")
    w = works.select("work_id", normal_doi(F.col("doi")).alias("doi"), normal_title(F.col("title")).alias("b"), F.col("year").alias("wy"))
    by_doi = r.where("doi is not null").join(w.where("doi is not null").groupBy("doi").agg(F.min("work_id").alias("work_id")), "doi").select("record_id", "work_id", F.lit("doi").alias("how"), F.lit(1.0).alias("similarity"))
    titles = links.unionByName(r.where("a <> ''").select("a").distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("similarity")))
    far = F.when(F.abs(F.col("year") - F.col("wy")) > 1, 0.1).otherwise(0.0)
    near = r.join(by_doi.select("record_id"), "record_id", "left_anti").join(titles, "a").join(w.where("b <> ''"), "b").select("record_id", "work_id", (F.col("similarity") - far).alias("s")).where(F.col("s") >= least)
    best = near.groupBy("record_id").agg(F.max(F.struct("s", (-F.col("work_id")).alias("m"))).alias("x")).select("record_id", (-F.col("x.m")).alias("work_id"), F.lit("title").alias("how"), F.col("x.s").alias("similarity"))
    found = by_doi.unionByName(best)
    one = found.groupBy("work_id").agg(F.min_by(F.struct("record_id", "how", "similarity"), "record_id").alias("x")).select("x.record_id", "work_id", "x.how", "x.similarity")
    return records.select("record_id").distinct().join(one, "record_id", "left")
