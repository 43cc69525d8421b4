"""Near-duplicate records: pairs, and classes with link counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.gray_index import near_pairs, near_sets
from quillspark.llm.shingles import gram_table
from quillspark.runtime import materialize, ship_package


def representatives(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Collapse equal texts: (rep, text, copies) with the smallest key of each text, and (rep, member) of repeated texts.
    Null text counts as empty; rows with a null key are left out; the aggregation combines before it shuffles."""
    ship_package(df.sparkSession)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("member"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    reps = materialize(rows.groupBy("text").agg(F.min("member").alias("rep"), F.count(F.lit(1)).alias("copies")), "representatives")
    repeated = reps.where("copies > 1").select("rep", F.sha2("text", 256).alias("digest"))
    members = rows.select("member", F.sha2("text", 256).alias("digest")).join(repeated, "digest").select("rep", "member").distinct()
    return reps, members


def near_duplicate_pairs(df: DataFrame, key: str, text: str, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """All pairs (id_a < id_b, jaccard) of rows whose n-word shingle sets reach ``similarity``; equal texts included.

    Texts with fewer than n words pair with nothing. Extra columns are ignored; an empty table gives no rows.
    """
    reps, members = representatives(df, key, text)
    grams = materialize(gram_table(reps, "rep", "text", n), "gram-sets")
    links = materialize(near_sets(grams, similarity), "near-links")
    members = materialize(members, "copies")
    a, b = members.toDF("id_a", "m_a"), members.toDF("id_b", "m_b")
    spread = links.join(a, "id_a", "left").join(b, "id_b", "left").select(F.coalesce("m_a", "id_a").alias("x"), F.coalesce("m_b", "id_b").alias("y"), "jaccard")
    shingled = grams.where(F.length("grams") > 0).select("rep")
    same = members.toDF("rep", "x").join(shingled, "rep", "left_semi").join(members.toDF("rep", "y"), "rep").where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    return spread.unionByName(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "jaccard")


def near_duplicate_classes(df: DataFrame, key: str, text: str, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per key: class_id (the smallest key that it is linked with, also through others) and links, the number
    of different texts that its own text is near to. Copies share their text's class and count."""
    reps, members = representatives(df, key, text)
    links = materialize(near_pairs(reps, n, similarity), "near-links")
    both = links.select(F.col("id_a").alias("rep"), F.col("id_b").alias("other")).unionByName(links.select(F.col("id_b").alias("rep"), F.col("id_a").alias("other")))
    degree = both.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    roots = components(links, "id_a", "id_b").toDF("rep", "class_id")
    by_rep = reps.select("rep").join(degree, "rep", "left").join(roots, "rep", "left")
    by_rep = by_rep.select("rep", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    copied = members.where("member <> rep").join(by_rep, "rep").select(F.col("member").alias(key), "class_id", "links")
    return by_rep.withColumnRenamed("rep", key).unionByName(copied)
