"""Incremental paths: streams of feedback and of records, folded by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.corpus import latest
from quillspark.operators.readers import ACTION_LISTS
from quillspark.runtime import delete, materialize, release


def newer_than(df: DataFrame, column: str, watermark: str | None) -> DataFrame:
    """Rows strictly newer than the watermark; with one, rows without a time are left out; without one all rows stay."""
    return df if watermark is None else df.where(F.col(column) > F.to_timestamp(F.lit(watermark)))


def profile_stream(events: DataFrame) -> DataFrame:
    """Streaming or static (user, list, items, last): the profile lists as a running aggregation. State holds each user's
    distinct items per list; run it in update or complete mode."""
    target = F.create_map(*[F.lit(x) for kv in ACTION_LISTS.items() for x in kv])[F.col("action")]
    return events.withColumn("list", target).where("list is not null").groupBy("user", "list").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("ts").alias("last"))


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Streaming or static (start, end, action, n) over event-time windows; later events than ``late`` are dropped from
    streams. This goes beyond the batch operators."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "action", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Streaming or static (user, start, end, n): sessions that end after a gap without events."""
    return events.withWatermark("ts", late).groupBy("user", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_stream(records: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, shards: int = 32):
    """Start a stream that keeps, under ``path``, the latest row of each key. Keys are spread over ``shards`` by hash, and a batch
    rewrites only the shards that it has keys of, as a new version beside the old one; :func:`current` reads the newest version
    of each. A batch that is run again writes the same versions again, and versions older than the last two are deleted."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = materialize(batch.withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")), "upsert-batch")
        known = _versions(spark, path)
        touched = {r[0] for r in rows.select("_shard").distinct().collect()}  # no more than there are shards
        for_batch = {s: max((n for n in known.get(s, []) if n < number), default=None) for s in touched}
        old = [f"{path}/_shard={s}/v={n}" for s, n in for_batch.items() if n is not None]
        both = rows
        if old:
            both = rows.unionByName(spark.read.option("basePath", path).parquet(*old).drop("v").withColumn("_shard", F.col("_shard").cast("int")), allowMissingColumns=True)
        out = latest(both, keys, order).repartition(F.col("_shard")).withColumn("v", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_shard", "v").parquet(path)
        for s in touched:
            for n in sorted(known.get(s, []))[:-1]:
                if n < number - 1:
                    delete(spark, f"{path}/_shard={s}/v={n}")
        release(rows)

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Version numbers of each shard under ``path``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: dict[int, list[int]] = {}
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_shard=*/v=*")) or []:
        version, shard = f.getPath().getName(), f.getPath().getParent().getName()
        out.setdefault(int(shard.split("=")[1]), []).append(int(version.split("=")[1]))
    return out


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every shard of a table kept by :func:`upsert_stream`."""
    newest = [f"{path}/_shard={s}/v={max(n)}" for s, n in sorted(_versions(spark, path).items())]
    return spark.read.option("basePath", path).parquet(*newest).drop("_shard", "v")
