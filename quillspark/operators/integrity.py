"""References to keys that are not there, or that came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.joins import skew_join
from quillspark.runtime import join_bounded, materialize, small_enough

#: Bits set per key, all in one 64-bit word, and keys per word: about 2 % of absent keys pass.
BLOOM_BITS = 4
KEYS_PER_WORD = 4
#: Words that stand packed in one row of the filter, as a power of two.
SHARD_BITS = 10


def _mask(h: Column) -> Column:
    one = F.lit(1).cast("bigint")
    out = None
    for k in range(BLOOM_BITS):
        bits = F.call_function("shiftleft", one, (F.shiftrightunsigned(h, 6 * k + 4).bitwiseAND(F.lit(63))).cast("int"))
        out = bits if out is None else out.bitwiseOR(bits)
    return out


def bloom_shards(parents: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """A blocked Bloom filter over the keys as rows (shard, words), each with 2**SHARD_BITS words packed in an array, and
    the number of its words. It takes two bytes a key."""
    n = -(-max(1, -(-count // KEYS_PER_WORD)) // (1 << SHARD_BITS)) << SHARD_BITS
    h = F.xxhash64(F.col(key))
    rows = parents.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(h), F.lit(n)).alias("word"), _mask(h).alias("bits"))
    words = rows.unionByName(parents.sparkSession.range(n).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    packed = words.groupBy(F.shiftright("word", SHARD_BITS).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("words"))
    return packed, n


def split_by_bloom(refs: DataFrame, ref: str, parents: DataFrame, key: str, count: int) -> tuple[DataFrame, DataFrame]:
    """(definite orphans, references that may have a parent). The filter is broadcast while its packed size is under the
    bound, for about 30 million keys; a larger one is joined shard by shard, hot shards apart."""
    shards, n = bloom_shards(parents, key, count)
    h = F.xxhash64(F.col(ref))
    word = F.pmod(F.xxhash64(h), F.lit(n))
    probed = refs.withColumns({"__shard": F.shiftright(word, SHARD_BITS), "__slot": word.bitwiseAND(F.lit((1 << SHARD_BITS) - 1)).cast("int"), "__mask": _mask(h)})
    shards = materialize(shards.toDF("__shard", "__words"), "bloom-filter")
    probed = probed.join(F.broadcast(shards), "__shard", "left") if small_enough(n, 9) else skew_join(probed, shards, "__shard", "left")
    bits = F.get("__words", F.col("__slot"))
    passes = F.coalesce(bits.bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))
    return probed.where(~passes).select(*refs.columns), probed.where(passes).select(*refs.columns)


def orphan_references(refs: DataFrame, parents: DataFrame, ref: str = "ref", key: str = "key", since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of ``refs`` with a ``ref`` that equals no ``key`` of ``parents``, and ``reason``: missing or later.

    With ``since`` (a time column of parents) and ``until`` (one of refs), a reference whose every parent came after it
    is an orphan too; a null time makes none. Null references are no case. Other columns of ``refs`` stay, but for one
    named reason. Keys may repeat: the earliest counts. A Bloom
    filter of the keys proves most orphans, without a shuffle while it can be broadcast under its size check; only what
    passes it is joined, by broadcast if the counted keys are few and otherwise by a shuffle that splits hot keys.
    """
    refs, known = refs.drop("reason"), parents.where(F.col(key).isNotNull())
    # a parent without a time may have come at any time, so it makes no later case
    earliest = F.when(F.count(since) < F.count(F.lit(1)), F.lit(None)).otherwise(F.min(since)) if since else F.lit(None).cast("timestamp")
    known = known.groupBy(F.col(key).alias(ref)).agg(earliest.alias("__since")).withColumn("__there", F.lit(True))
    count = known.count()
    real = refs.where(F.col(ref).isNotNull())
    sure, rest = split_by_bloom(real, ref, parents, key, count)
    width = 128  # an id, a time and their place in the hash table
    met = join_bounded(rest, known, ref, "left", count, width) if small_enough(count, width) else skew_join(rest, known, ref, "left")
    late = F.coalesce(F.col("__since") > F.col(until), F.lit(False)) if since and until else F.lit(False)
    met = met.where(F.col("__there").isNull() | late).withColumn("reason", F.when(F.col("__there").isNull(), "missing").otherwise("later")).select(*refs.columns, "reason")
    return sure.withColumn("reason", F.lit("missing")).unionByName(met)


def normal_identifier(c: Column) -> Column:
    """One spelling of a paper identifier: no outer blanks or case, no doi tag or address, arxiv and openalex addresses
    as tags, no arxiv version. Null stays null; a blank gives the empty string."""
    c = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    c = F.regexp_replace(c, r"^https://doi\.org/", "")
    c = F.regexp_replace(c, r"^doi:\s*", "")
    c = F.regexp_replace(c, r"^https://arxiv\.org/abs/", "arxiv:")
    c = F.regexp_replace(c, r"^https://openalex\.org/", "openalex:")
    return F.regexp_replace(c, r"^(arxiv:.*[^v\d])v\d+$|^(arxiv:.*\d)v\d+$", "$1$2")


def citation_orphans(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Ends of citation edges with no paper, or with one stored after the edge: (ref_table, ref_key, ref_field,
    ref_value, period, reason); period is the month of the edge's created_at, null if it has none."""
    ends = edges.select(
        F.col("edge_id").cast("string").alias("ref_key"),
        F.col("created_at").alias("_at"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("ref")) for c in ("source_paper_id", "target_paper_id")])),
    )
    found = orphan_references(ends, papers.select(F.col("id").alias("key"), F.col("created_at").alias("_born")), since="_born", until="_at")
    return found.select(F.lit("citation_edges").alias("ref_table"), "ref_key", "ref_field", F.col("ref").cast("string").alias("ref_value"), F.date_format("_at", "yyyy-MM").alias("period"), "reason").distinct()


def record_orphans(records: DataFrame) -> DataFrame:
    """References of ingest records that name no record, by external id or doi. The columns are those of
    :func:`citation_orphans`; records sent again count once per reference, in the month they were first fetched."""
    keys = records.select(F.explode(F.array("external_id", "doi")).alias("key")).select(normal_identifier(F.col("key")).alias("key")).where("key <> ''")
    refs = records.select(F.col("external_id").alias("ref_key"), F.col("fetched_at").alias("_at"), F.explode("reference_ids").alias("ref_value"))
    refs = refs.withColumn("ref", normal_identifier(F.col("ref_value"))).where("ref <> ''")
    found = orphan_references(refs, keys).groupBy("ref_key", "ref_value").agg(F.min("_at").alias("_at"))
    return found.select(F.lit("sample_papers").alias("ref_table"), "ref_key", F.lit("reference_ids").alias("ref_field"), "ref_value", F.date_format("_at", "yyyy-MM").alias("period"), F.lit("missing").alias("reason"))
