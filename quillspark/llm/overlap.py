"""Records that stand in an evaluation split and, exactly or almost, in the training split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shingles import by_rarity, distinct_shingles, parts, rarity, verify_udf
from quillspark.operators.joins import block_join
from quillspark.runtime import materialize, ship_package, spread

#: The spellings of each split.
SPLIT_NAMES = {"train": "train", "training": "train", "val": "val", "dev": "val", "valid": "val", "validation": "val", "test": "test"}


def split_name(col: str):
    """train, val or test for any spelling of it; null for null and anything else."""
    return F.create_map(*[F.lit(x) for kv in SPLIT_NAMES.items() for x in kv])[F.lower(F.trim(F.col(col)))]


def _ngram_rows(entries: DataFrame, n: int, similarity: float, counts) -> DataFrame:
    """(cell, rep, in_train, in_eval): the rarest n-gram hashes of each entry, joined with its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for b in batches:
            for part in parts(b, 1):
                s, d = distinct_shingles(part.column(1).to_pylist(), n)
                s, d, place, size = by_rarity(s, d, order)
                keep = place <= size - np.ceil(size * similarity - 1e-9)
                s, d = s[keep], d[keep]
                key = part.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
                at = pa.array(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((s ^ (key[d] * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)), part.column(0).take(at), part.column(3).take(at), part.column(4).take(at)],
                    ["cell", "rep", "in_train", "in_eval"],
                )

    return entries.select("rep", "text", "key", "in_train", "in_eval").mapInArrow(run, "cell bigint, rep bigint, in_train boolean, in_eval boolean")


#: Entries of one cell and side that meet as many of the other in one task.
CELL_ROWS = 2048


def overlap_links(df: DataFrame, example: str, split: str, key: str, text: str, n: int = 3, similarity: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(links, rows): links (digest_t, digest_e, jaccard, containment) of the different texts of one key of which one stands
    in train and the other in val or test and which are equal or near, and the rows (id, digest, train) that have them.

    Rows with a null id, key or unassigned split take no part. Null text equals null text and is near nothing else (equal
    texts without shingles have jaccard and containment 1). Equal texts of one key are one entry, whatever their number.
    """
    ship_package(df.sparkSession)
    rows = df.select(F.col(example).cast("bigint").alias("id"), split_name(split).alias("part"), F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.where("id is not null and key is not null and part is not null").withColumn("train", F.col("part") == "train")
    shared = rows.groupBy("key").agg(F.max("train").alias("t"), F.min("train").alias("e")).where("t and not e").select("key")
    rows = rows.join(shared, "key", "left_semi").withColumn("digest", F.xxhash64("key", F.sha2("text", 256)))
    entries = rows.groupBy("digest", "key", "text").agg(F.min("id").alias("rep"), F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval"))
    entries = materialize(spread(entries), "overlap-entries")
    counts = df.sparkSession.sparkContext.broadcast(rarity(entries, "text", n))
    grams = materialize(_ngram_rows(entries, n, similarity, counts), "overlap-grams")
    held_out = grams.where("in_eval").select("cell", F.col("rep").alias("rep_e"))
    training = grams.where("in_train").select("cell", F.col("rep").alias("rep_t"))
    hits = block_join(held_out, training, "cell", CELL_ROWS, "rep_e", "rep_t").where("rep_e <> rep_t").select("rep_e", "rep_t").distinct()
    texts = entries.select("rep", "text", "digest")
    near = hits.join(texts.toDF("rep_t", "text_t", "digest_t"), "rep_t").join(texts.toDF("rep_e", "text_e", "digest_e"), "rep_e")
    near = near.withColumn("v", verify_udf(n)("text_e", "text_t"))
    near = near.select("digest_t", "digest_e", (F.col("v.shared") / (F.col("v.in_a") + F.col("v.in_b") - F.col("v.shared"))).alias("jaccard"), (F.col("v.shared") / F.col("v.in_a")).alias("containment"))
    near = near.where(F.col("jaccard") >= similarity)
    same = entries.where("in_train and in_eval").select(F.col("digest").alias("digest_t"), F.col("digest").alias("digest_e"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("containment"))
    return materialize(near.unionByName(same), "overlap-links"), rows.select("id", "digest", "train")


def cross_split_overlaps(df: DataFrame, example: str, split: str, key: str, text: str, n: int = 3, similarity: float = 0.5) -> DataFrame:
    """Pairs (train_id, eval_id, jaccard, containment) of a train row and a val or test row with equal ``key`` and with
    equal or near ``text`` (Jaccard of n-word shingles at least ``similarity``); containment is the share of the
    evaluation record's shingles that the training record holds. The rows of :func:`overlap_links` are expanded at the
    end; copied rows under one id count once."""
    links, members = overlap_links(df, example, split, key, text, n, similarity)
    train = members.where("train").select(F.col("id").alias("train_id"), F.col("digest").alias("digest_t"))
    held = members.where("not train").select(F.col("id").alias("eval_id"), F.col("digest").alias("digest_e"))
    return links.join(train.distinct(), "digest_t").join(held.distinct(), "digest_e").select("train_id", "eval_id", "jaccard", "containment")


def overlap_report(df: DataFrame, example: str, split: str, source: str, key: str, text: str, n: int = 3, similarity: float = 0.5) -> DataFrame:
    """Per evaluation split and source: evaluation rows with an overlap, training rows they meet, pairs, and the largest
    containment. Counted from links between different texts and the rows of each, without forming the pairs of rows."""
    links, members = overlap_links(df, example, split, key, text, n, similarity)
    about = df.select(F.col(example).cast("bigint").alias("id"), split_name(split).alias("eval_split"), F.col(source).alias("source")).distinct()
    held = members.where("not train").select("id", "digest").distinct().join(about, "id").where("eval_split <> 'train'")
    held = materialize(held.groupBy(F.col("digest").alias("digest_e"), "eval_split", "source").agg(F.countDistinct("id").alias("n_e")), "overlap-held")
    train = members.where("train").groupBy(F.col("digest").alias("digest_t")).agg(F.countDistinct("id").alias("n_t"))
    met = materialize(links.join(held, "digest_e").join(train, "digest_t"), "overlap-met")
    by = ["eval_split", "source"]
    rows = met.select("digest_e", *by, "n_e").distinct().groupBy(*by).agg(F.sum("n_e").alias("eval_rows"))
    trained = met.select("digest_t", *by, "n_t").distinct().groupBy(*by).agg(F.sum("n_t").alias("train_rows"))
    pairs = met.groupBy(*by).agg(F.sum(F.col("n_e") * F.col("n_t")).alias("pairs"), F.max("containment").alias("most_contained"))
    same = lambda a, b: F.col(f"{a}.eval_split").eqNullSafe(F.col(f"{b}.eval_split")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    out = pairs.alias("p").join(rows.alias("r"), same("p", "r")).join(trained.alias("t"), same("p", "t"))
    return out.select("p.eval_split", "p.source", "eval_rows", "train_rows", "pairs", "most_contained")
