"""Exact radius join of strings under an edit metric, by metric-space partitioning.

The metric is the unrestricted Damerau-Levenshtein distance: insertions, deletions, substitutions and swaps of
neighbours, where a swapped pair may be edited further; unlike the restricted variant it keeps the triangle inequality.
Every string goes to the cell of its nearest pivot. If two strings x and y are within radius r and y lives in the cell
of pivot p, then d(x, p) <= d(x, p_x) + 2 r, so x is replicated to every cell for which that holds and each pair meets
in the home cell of one of its strings. Inside a cell, distances to further pivots exclude pairs before the metric runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import materialize, ship_package, spread

#: Pivots of a small table, up to PIVOTS_ROWS strings; beyond, they grow with the square root of the strings up to a bound,
#: so that cells grow no faster.
PIVOTS, PIVOTS_ROWS, MOST_PIVOTS = 48, 40_000, 512
#: Pivots are chosen among so many strings, taken by hash; a fixed bound.
PIVOT_SAMPLE = 1500
#: Strings of a cell that are compared with all of it at once; bounds the memory of a task.
BLOCK = 1024


def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of code points padded with 0, and their lengths."""
    size = np.array([len(s) for s in strings], np.int64)
    out = np.zeros((len(strings), max(1, int(size.max(initial=0)))), np.int32)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32)
    return out, size


def distances(pattern: str, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance of one string to every row of ``codes``, all rows at a time."""
    p, (n, width) = [ord(c) for c in pattern], codes.shape
    m = len(p)
    top = m + width + 1
    d = np.full((m + 2, width + 2, n), top, np.int32)
    d[1, 1:, :] = np.arange(width + 1)[:, None]
    d[1:, 1, :] = np.arange(m + 1)[:, None]
    last_row: dict[int, int] = {}
    rows = np.arange(n)
    for i in range(1, m + 1):
        last_col = np.zeros(n, np.int64)
        before = np.zeros(codes.shape, np.int64)  # last earlier row of the pattern with the row's character
        for c, r in last_row.items():
            before[codes == c] = r
        for j in range(1, width + 1):
            same = codes[:, j - 1] == p[i - 1]
            k, l = before[:, j - 1], last_col
            swap = d[k, l, rows] + (i - k - 1) + 1 + (j - l - 1)
            swap = np.where((k > 0) & (l > 0), swap, top)
            d[i + 1, j + 1] = np.minimum(np.minimum(d[i, j] + ~same, swap), np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            last_col = np.where(same, j, last_col)
        last_row[p[i - 1]] = i
    return d[m + 1, size + 1, rows]


def choose_pivots(sample: list[str], count: int = PIVOTS) -> list[str]:
    """Spread-out strings: each next pivot is the one farthest from those chosen so far (ties to the smaller string)."""
    sample = sorted(set(sample))
    if not sample:
        return [""]
    codes, size = encode(sample)
    out, far = [], np.full(len(sample), 1 << 30)
    at = 0
    for _ in range(min(count, len(sample))):
        out.append(sample[at])
        far = np.minimum(far, distances(sample[at], codes, size))
        at = int(far.argmax())
        if far[at] == 0:
            break
    return out


def radius_pairs(strings: DataFrame, column: str, radius: int = 1) -> DataFrame:
    """(a, b, distance), a < b: all pairs of different strings of ``column`` with an edit distance of at most ``radius``.

    Null and empty strings take no part, repeated ones count once. Exact for every radius.
    """
    spark = strings.sparkSession
    ship_package(spark)
    rows = materialize(strings.where(F.length(column) > 0).select(F.col(column).alias("s")).distinct(), "metric-strings")
    total = rows.count()
    share = min(1.0, PIVOT_SAMPLE / max(1, total))
    sample = [r[0] for r in rows.where(F.pmod(F.xxhash64("s", F.lit(23)), F.lit(1 << 30)) <= int(share * (1 << 30))).collect()]
    count = min(MOST_PIVOTS, int(PIVOTS * max(1.0, total / PIVOTS_ROWS) ** 0.5))
    pivots = spark.sparkContext.broadcast(choose_pivots(sample, count))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (cell, home, s, sign): sign holds the distances to the pivots, one byte each."""
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                col = b.column(0).slice(start, 4096)
                codes, size = encode(col.to_pylist())
                d = np.stack([distances(p, codes, size) for p in pivots.value], axis=1)
                near = d.argmin(axis=1)
                who, cell = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * radius)
                sign = np.minimum(d, 255).astype(np.uint8)
                marks = pa.array([x.tobytes() for x in sign], pa.binary()).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(near[who] == cell), col.take(pa.array(who)), marks], ["cell", "home", "s", "sign"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (cell, part), home strings last: the streamed home strings meet the strings held of their part."""
        now, held, marks, sizes = None, [], [], []
        for b in batches:
            cell, part, home = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            text, sign = b.column(3).to_pylist(), b.column(4).to_pylist()
            start = 0
            while start < len(cell):
                key = (cell[start], part[start], home[start])
                stop = start
                while stop < len(cell) and (cell[stop], part[stop], home[stop]) == key:
                    stop += 1
                if key[:2] != now:
                    now, held, marks = key[:2], [], []
                s = text[start:stop]
                m = np.frombuffer(b"".join(sign[start:stop]), np.uint8).reshape(stop - start, -1).astype(np.int16)
                if not key[2]:
                    held.extend(s), marks.append(m)
                elif held:
                    marks = [np.concatenate(marks)]
                    out = _within(s, m, held, marks[0], radius)
                    if out.num_rows:
                        yield out
                start = stop

    routed = materialize(spread(rows).mapInArrow(route, "cell int, home boolean, s string, sign binary"), "metric-cells")
    # every string of a cell is held in one of its parts, by hash; the home strings visit all parts
    parts = routed.groupBy("cell").count().select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    parts = materialize(parts, "cell-parts")
    sized = routed.join(F.broadcast(parts), "cell")  # at most MOST_PIVOTS rows
    # few bytes but much work a part: a fixed number of partitions, since small ones would be put together in one task
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(10_000, parts.agg(F.sum("parts")).first()[0] or 1))
    own = sized.select("cell", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("home"), "s", "sign")
    visits = sized.where("home").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("home"), "s", "sign")
    near = own.unionByName(visits).repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "home").mapInArrow(compare, "a string, b string, distance int")
    return near.distinct()


def _within(s: list[str], m: np.ndarray, held: list[str], marks: np.ndarray, radius: int) -> pa.RecordBatch:
    left, right, dist = [], [], []
    codes, size = encode(held)
    for i, x in enumerate(s):
        # |d(x, p) - d(y, p)| <= d(x, y) for every pivot p
        ok = np.flatnonzero(np.abs(size - len(x)) <= radius)
        ok = ok[(np.abs(marks[ok] - m[i]) <= radius).all(axis=1)]
        if not len(ok):
            continue
        d = distances(x, codes[ok][:, : len(x) + radius], size[ok])
        for j, k in zip(ok[d <= radius], d[d <= radius]):
            if held[j] != x:
                left.append(min(x, held[j])), right.append(max(x, held[j])), dist.append(int(k))
    return pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(dist, pa.int32())], ["a", "b", "distance"])
