"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the left rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.005
#: No key with fewer rows is hot.
HOT_ROWS = 100_000


def hot_keys(counts: DataFrame, key: str, total: int) -> list:
    """The hot keys of a table (key, count) of all keys: at most 1 / HOT_SHARE values."""
    if total <= HOT_ROWS:
        return []
    return [r[0] for r in counts.where(F.col("count") > max(HOT_ROWS, total * HOT_SHARE)).select(key).limit(int(1 / HOT_SHARE) + 1).collect()]


def split_join(left: DataFrame, right: DataFrame, key: str, how: str, hot: list) -> DataFrame:
    """Join on ``key``, unique in ``right``: rows of the given hot keys meet a broadcast of the few right rows with these
    keys, all others shuffle. Null keys match nothing."""
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.where(F.col(key).isin(hot)))
    return left.where(is_hot).join(few, key, how).unionByName(left.where(~is_hot).join(right, key, how))


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """:func:`split_join` that finds the hot keys itself. ``left`` is read twice or more and should be a table."""
    total = left.count()
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count() if total > HOT_ROWS else left.limit(0).groupBy(key).count()
    return split_join(left, right, key, how, hot_keys(counts, key, total))


def block_join(left: DataFrame, right: DataFrame, key: str, rows: int, salt_left: str, salt_right: str) -> DataFrame:
    """Inner join on a bigint ``key`` that may be frequent on both sides. The rows of a key with more than ``rows`` rows on a
    side are cut into blocks by a hash of the salt column, and each block of one side meets each block of the other in a
    task of its own; rows of other keys are not copied. Both sides should be tables or cheap to compute twice. The two
    sides share no column but the key."""
    sizes = left.groupBy(key).count().withColumnRenamed("count", "nl").join(right.groupBy(key).count().withColumnRenamed("count", "nr"), key)
    blocks = lambda n: F.ceil(F.col(n) / rows).cast("int")
    hot = sizes.where((F.col("nl") > rows) | (F.col("nr") > rows)).select(key, blocks("nl").alias("__kl"), blocks("nr").alias("__kr"))
    own = lambda salt, n: F.pmod(F.xxhash64(salt, F.lit(7)), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    a = left.join(hot, key, "left").select(*left.columns, own(salt_left, F.col("__kl")).alias("__a"), every("__kr").alias("__b"))
    b = right.join(hot, key, "left").select(*right.columns, every("__kl").alias("__a"), own(salt_right, F.col("__kr")).alias("__b"))
    return a.join(b, [key, "__a", "__b"]).drop("__a", "__b")
