"""Word shingles as 64-bit hashes, computed for a whole Arrow batch at a time."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import spread

_WORD = re.compile(r"[^\W_]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_CACHE_WORDS = 1 << 19
_known: dict[str, int] = {}

#: Buckets of the rarity sketch. Its size is fixed, whatever the corpus; it only orders shingles.
RARITY_BITS = 17


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits after NFKC and lower-casing; null gives none."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


def _hashes(flat: list[str]) -> np.ndarray:
    known = _known
    if len(known) > _CACHE_WORDS:
        known.clear()
    for w in set(flat).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and the text number of each."""
    lists = [words(t) for t in texts]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return _hashes([w for x in lists for w in x]), doc


def shingle_stream(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes in reading order, the text number of each, and its position in the text."""
    h, doc = word_stream(texts)
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        s = h[:size].copy()
        for k in range(1, n):
            s = mix(s * _MIX[0] + h[k : k + size])
        s = mix(s)
    first = np.searchsorted(doc, np.arange(len(texts)))
    keep = doc[:size] == doc[n - 1 :]
    d = doc[:size][keep]
    return s[keep], d, np.arange(size)[keep] - first[d]


def distinct_shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, by text and value, and the text number of each."""
    s, d, _ = shingle_stream(texts, n)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    if len(s):
        fresh = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])]
        s, d = s[fresh], d[fresh]
    return s, d


def parts(batch: pa.RecordBatch, text: int, rows: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``rows`` rows and, beyond one row, about ``size`` characters of text."""
    long = pa.compute.fill_null(pa.compute.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < batch.num_rows:
        base = long[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(long, base + size, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def rarity(df: DataFrame, text: str, n: int) -> np.ndarray:
    """Text counts of shingles by hash bucket over the whole of ``df``: a fixed 2**RARITY_BITS numbers.

    Any order that is the same for all rows keeps prefix filters exact; this one puts frequent shingles last, so that
    they are not used as join keys. Each task sends its own counts once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for b in batches:
            for part in parts(b, 0):
                s, _ = distinct_shingles(part.column(0).to_pylist(), n)
                total += np.bincount((s >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "texts"])

    rows = df.select(text).mapInArrow(count, "bucket int, texts bigint").groupBy("bucket").agg(F.sum("texts").alias("texts")).toPandas()
    out = np.zeros(1 << RARITY_BITS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["texts"].to_numpy()
    return out


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a column of packed sets in one array, and the row number of each."""
    size = (pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False) // 8).astype(np.int64)
    return np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), np.uint64), np.repeat(np.arange(len(size)), size)


def gram_table(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, grams): the distinct n-word shingles of every text as packed 64-bit hashes in ascending order, so that texts
    are read once, whatever is done with their shingles. Texts without shingles have an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, 1):
                s, d = distinct_shingles(part.column(1).to_pylist(), n)
                ends = np.searchsorted(d, np.arange(1, part.num_rows + 1)) * 8
                raw, cuts = s.tobytes(), np.r_[0, ends]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[i:j] for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())], [key, "grams"])

    return spread(df.select(F.col(key).cast("bigint"), F.col(text).cast("string"))).mapInArrow(run, f"{key} bigint, grams binary")


def gram_rarity(grams: DataFrame) -> np.ndarray:
    """As :func:`rarity`, from packed sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for b in batches:
            s, _ = unpack(b.column(0))
            total += np.bincount((s >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "texts"])

    rows = grams.select("grams").mapInArrow(count, "bucket int, texts bigint").groupBy("bucket").agg(F.sum("texts").alias("texts")).toPandas()
    out = np.zeros(1 << RARITY_BITS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["texts"].to_numpy()
    return out


def common_grams(a: str, b: str):
    """Sizes of two columns of packed sets and of what they share, as a struct."""

    @F.pandas_udf("in_a int, in_b int, shared int")
    def common(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(a), 3), np.int32)
        for i, (x, y) in enumerate(zip(a, b)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            out[i] = len(x), len(y), np.count_nonzero(both[1:] == both[:-1])
        return pd.DataFrame(out, columns=["in_a", "in_b", "shared"])

    return common(a, b)


def by_rarity(s: np.ndarray, d: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each text, rarest first: (shingle, text number, place in the order, shingles of that text)."""
    c = counts[(s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
    order = np.lexsort((s, c, d))
    s, d = s[order], d[order]
    n_of = np.bincount(d, minlength=(int(d[-1]) + 1) if len(d) else 0)
    starts = np.r_[0, np.cumsum(n_of)[:-1]] if len(n_of) else np.zeros(0, np.int64)
    return s, d, np.arange(len(s)) - starts[d], n_of[d]


def shared_counts(left: list[str | None], right: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For aligned texts: distinct shingles of the left, of the right, and of both."""
    size = len(left)
    s, d = distinct_shingles(left, n)
    t, e = distinct_shingles(right, n)
    a, b = np.bincount(d, minlength=size), np.bincount(e, minlength=size)
    # row-wise intersection: tag each shingle by its row, then count repeats
    v, r = np.concatenate((s, t)), np.concatenate((d, e))
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    both = np.bincount(r[1:][(v[1:] == v[:-1]) & (r[1:] == r[:-1])], minlength=size) if len(v) else np.zeros(size, np.int64)
    return a, b, both


def verify_udf(n: int):
    """Arrow function of two text columns: struct of their shingle counts and the count they share."""

    @F.pandas_udf("in_a int, in_b int, shared int")
    def verify(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y, z = shared_counts(list(a), list(b), n)
        return pd.DataFrame({"in_a": x.astype(np.int32), "in_b": y.astype(np.int32), "shared": z.astype(np.int32)})

    return verify
