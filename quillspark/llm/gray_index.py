"""Gray-order hierarchical index over set fingerprints, and the near-duplicate join built on it.

A fingerprint is the parity bitmap of a record's shingle set: each shingle flips one of BITS bits. Two fingerprints
differ in at most as many bits as the sets differ in elements, so similarity t bounds the difference by
(1 - t) / (1 + t) * (|A| + |B|): pruning by it loses nothing.

The index sorts fingerprints by Gray rank, so that neighbours differ in few bits, packs them into groups of FANOUT, and
factors out of each group the bits all its members share (mask and pattern). A search adds up the differences between
its own bits and the patterns from the top down and drops a whole group once the sum passes the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shingles import RARITY_BITS, by_rarity, common_grams, gram_rarity, gram_table, unpack
from quillspark.runtime import materialize, ship_package

WORDS64 = 4
BITS = 64 * WORDS64
FANOUT = 16
#: Cells with more rows than this are split into blocks that are compared block by block.
BLOCK = 2048


def fingerprints(s: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
    """Parity bitmaps of the shingle sets of ``size`` texts, as rows of WORDS64 unsigned words."""
    out = np.zeros((size, WORDS64), np.uint64)
    bit = s & np.uint64(BITS - 1)
    np.bitwise_xor.at(out, (d, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Rank of each fingerprint in Gray order: bit i of the rank is the parity of the bits from the top down to i."""
    rank = fp.copy()
    carry = np.zeros(len(fp), np.uint64)
    for w in range(fp.shape[1]):
        x = rank[:, w]
        for shift in (1, 2, 4, 8, 16, 32):
            x = x ^ (x >> np.uint64(shift))
        x = np.where(carry == 1, ~x, x)
        rank[:, w] = x
        carry = x & np.uint64(1)
    return rank


class GrayIndex:
    """Levels of groups over fingerprints in Gray order; each level holds mask, pattern and the largest set below."""

    def __init__(self, fp: np.ndarray, sizes: np.ndarray):
        rank = gray_rank(fp)
        self.order = np.lexsort(rank.T[::-1])
        self.fp, self.sizes = fp[self.order], sizes[self.order]
        self.levels = []
        mask = np.full_like(self.fp, ~np.uint64(0))
        pattern, top = self.fp, self.sizes
        while len(pattern) > FANOUT:
            cuts = np.arange(0, len(pattern), FANOUT)
            same = np.bitwise_and.reduceat(mask, cuts) & ~(np.bitwise_or.reduceat(pattern & mask, cuts) ^ np.bitwise_and.reduceat(pattern | ~mask, cuts))
            mask, pattern, top = same, np.bitwise_and.reduceat(pattern, cuts) & same, np.maximum.reduceat(top, cuts)
            self.levels.append((mask, pattern, top))

    def within(self, fp: np.ndarray, sizes: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, indexed row) whose difference is at most ``slack`` times the sum of their set sizes."""
        depth = len(self.levels)
        width = len(self.levels[-1][0]) if depth else len(self.fp)
        q = np.repeat(np.arange(len(fp)), width)
        node = np.tile(np.arange(width), len(fp))
        for level in range(depth - 1, -1, -1):
            mask, pattern, top = self.levels[level]
            off = np.bitwise_count((fp[q] ^ pattern[node]) & mask[node]).sum(axis=1)
            keep = off <= slack * (sizes[q] + top[node]) + 1e-9
            q, node = q[keep], node[keep]
            below = len(self.levels[level - 1][0]) if level else len(self.fp)
            q = np.repeat(q, FANOUT)
            node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            real = node < below
            q, node = q[real], node[real]
        off = np.bitwise_count(fp[q] ^ self.fp[node]).sum(axis=1)
        keep = off <= slack * (sizes[q] + self.sizes[node]) + 1e-9
        return q[keep], self.order[node[keep]]


def _fits(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two records that meet at the given rarity places can still reach the similarity, this being the first shingle
    that they share: a true pair fits at that one, so pairs that do not fit may be dropped."""
    need = np.ceil(similarity / (1 + similarity) * (a[:, N] + b[:, N]) - 1e-9)
    return np.minimum(a[:, N] - a[:, PLACE], b[:, N] - b[:, PLACE]) >= need


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(a[:, FP:]).view(np.uint64) ^ np.ascontiguousarray(b[:, FP:]).view(np.uint64)).sum(axis=1)


def _cell_pairs(g: np.ndarray, similarity: float, side_a=None, side_b=None):
    """Pairs of rows inside one cell, or between two blocks of it, that may reach the similarity."""
    slack = (1 - similarity) / (1 + similarity)
    a = np.arange(len(g)) if side_a is None else np.flatnonzero(side_a)
    b = np.arange(len(g)) if side_b is None else np.flatnonzero(side_b)
    fp = np.ascontiguousarray(g[:, FP:]).view(np.uint64)
    index = GrayIndex(fp[b], g[b, N])
    left, right = [], []
    for k in range(0, len(a), 256):
        q, r = index.within(fp[a[k : k + 256]], g[a[k : k + 256], N], slack)
        q, r = a[k : k + 256][q], b[r]
        if side_a is None:
            q, r = q[q < r], r[q < r]
        ok = _fits(g[q], g[r], similarity)
        left.append(g[q[ok], REP])
        right.append(g[r[ok], REP])
    return np.concatenate(left), np.concatenate(right)


#: Columns of the rows that are compared.
CELL, TASK, SIDE, REP, N, PLACE, FP = range(7)


def _pairs_of_sorted(similarity: float):
    """mapInArrow function over rows sorted by (cell, task cell): keeps one cell at a time in memory, at most 2 blocks."""
    slack = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(rows, whole):
            """Pairs of all cells in ``rows`` but the last, which may go on, unless ``whole``."""
            edge = np.flatnonzero((rows[1:, CELL] != rows[:-1, CELL]) | (rows[1:, TASK] != rows[:-1, TASK])) + 1
            cuts = np.r_[0, edge, len(rows)]
            last = len(cuts) - 1 if whole else len(cuts) - 2
            lengths = np.diff(cuts)[:last]
            left, right = [], []
            fresh = cuts[:last]
            for size in range(2, FANOUT + 1):  # small cells of one size are compared all at once
                i, j = np.triu_indices(size, 1)
                heads = fresh[lengths == size]
                if not len(heads):
                    continue
                a, b = rows[(heads[:, None] + i).ravel()], rows[(heads[:, None] + j).ravel()]
                ok = _fits(a, b, similarity) & ((a[:, TASK] == 0) | (a[:, SIDE] != b[:, SIDE]))
                a, b = a[ok], b[ok]
                ok = _far(a, b) <= slack * (a[:, N] + b[:, N]) + 1e-9
                left.append(a[ok, REP]), right.append(b[ok, REP])
            for k in np.flatnonzero(lengths > FANOUT):
                g = rows[cuts[k] : cuts[k + 1]]
                if g[0, TASK] == 0:
                    x, y = _cell_pairs(g, similarity)
                else:
                    sides = np.unique(g[:, SIDE])
                    if len(sides) < 2:
                        continue
                    x, y = _cell_pairs(g, similarity, g[:, SIDE] == sides[0], g[:, SIDE] == sides[1])
                left.append(x), right.append(y)
            x = np.concatenate(left) if left else np.zeros(0, np.int64)
            y = np.concatenate(right) if right else np.zeros(0, np.int64)
            pair = np.unique(np.c_[np.minimum(x, y), np.maximum(x, y)], axis=0)
            pair = pair[pair[:, 0] != pair[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["id_a", "id_b"]), rows[cuts[last] :]

        for b in batches:
            rows = np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for k in range(b.num_columns)])
            held.append(rows)
            joined = np.concatenate(held) if len(held) > 1 else rows
            out, rest = emit(joined, False)
            held = [rest] if len(rest) else []
            if out.num_rows:
                yield out
        if held:
            out, _ = emit(np.concatenate(held), True)
            if out.num_rows:
                yield out

    return run


CELL_SCHEMA = "cell bigint, rep bigint, n bigint, place bigint, " + ", ".join(f"f{k} bigint" for k in range(WORDS64))


def _prefixes(column: pa.Array, similarity: float, order: np.ndarray):
    """(shingle, row number, size of its set, place) of the rarest shingles of packed sets, and the fingerprints."""
    s, d = unpack(column)
    fp = fingerprints(s, d, len(column)).view(np.int64)
    s, d, place, size = by_rarity(s, d, order)
    keep = place <= size - np.ceil(size * similarity - 1e-9)
    return s[keep], d[keep], size[keep].astype(np.int64), place[keep].astype(np.int64), fp


def cells(grams: DataFrame, similarity: float, counts) -> DataFrame:
    """Rows (cell, rep, n, place, fingerprint): each record stands in the cells of its rarest shingles, enough of them that
    two records with the given similarity must meet in one (prefix filter under one fixed order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                s, d, size, place, fp = _prefixes(part.column(1), similarity, counts.value)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.view(np.int64)), pa.array(ids[d]), pa.array(size), pa.array(place), *(pa.array(fp[d, k]) for k in range(WORDS64))],
                    ["cell", "rep", "n", "place", *(f"f{k}" for k in range(WORDS64))],
                )

    return grams.select("rep", "grams").mapInArrow(run, CELL_SCHEMA)


def hot_cells(grams: DataFrame, similarity: float, counts) -> DataFrame:
    """(cell, blocks) of the cells of more than BLOCK records. The rarity counts are upper bounds, so only shingles whose
    bucket holds more than BLOCK are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                s, *_ = _prefixes(b.slice(start, 2000).column(0), similarity, counts.value)
                s = s[counts.value[(s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)] > BLOCK]
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["cell"])

    if int(counts.value.max(initial=0)) <= BLOCK:
        return grams.limit(0).selectExpr("rep as cell", "0 as blocks")
    found = grams.select("grams").mapInArrow(run, "cell bigint").groupBy("cell").count().where(F.col("count") > BLOCK)
    return found.select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))


def blocked(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Give each row its task cells. A cell of up to BLOCK rows is one task cell (0). A larger one is cut into blocks by
    record hash and each row is sent to every pair of blocks that its own block is in: all pairs still meet, no task
    holds more than two blocks, and the number of comparisons does not change."""
    hot = materialize(hot, "hot-cells")
    if hot.isEmpty():
        return rows.select("cell", F.lit(0).cast("bigint").alias("task"), F.lit(0).cast("bigint").alias("side"), *rows.columns[1:])
    b = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    tasks = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).cast("bigint").alias("task"), F.lit(0).cast("bigint").alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda o: F.struct((F.least(b, o).cast("bigint") * F.lit(1 << 20) + F.greatest(b, o) + 1).alias("task"), b.cast("bigint").alias("side")),
        )
    )
    # a diagonal task holds one block only, compared with itself: it gets task 0 under a cell of its own
    spread = rows.join(hot, "cell", "left").withColumn("t", F.explode(tasks))
    own = F.col("blocks").isNotNull() & (F.col("t.task") == F.col("t.side") * F.lit(1 << 20) + F.col("t.side") + 1)
    return spread.select(
        F.when(own, F.xxhash64("cell", "t.side")).otherwise(F.col("cell")).alias("cell"),
        F.when(own, F.lit(0).cast("bigint")).otherwise(F.col("t.task")).alias("task"),
        F.col("t.side").alias("side"),
        *rows.columns[1:],
    )


def near_pairs(reps: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """Pairs (id_a < id_b, jaccard) of rows of ``reps(rep bigint, text string)`` whose n-word shingle sets have a
    Jaccard similarity of at least ``similarity``. ``rep`` must be unique. Texts with fewer than n words have no
    shingles and no pair. Exact: prefix cells, Gray index and parity bound lose nothing, and each pair is verified."""
    ship_package(reps.sparkSession)
    return near_sets(materialize(gram_table(reps, "rep", "text", n), "gram-sets"), similarity)


def near_sets(grams: DataFrame, similarity: float) -> DataFrame:
    """As :func:`near_pairs`, of a table (rep, grams) of packed sets."""
    counts = grams.sparkSession.sparkContext.broadcast(gram_rarity(grams))
    split = blocked(cells(grams, similarity, counts), hot_cells(grams, similarity, counts))
    found = split.repartition("cell", "task").sortWithinPartitions("cell", "task").mapInArrow(_pairs_of_sorted(similarity), "id_a bigint, id_b bigint").distinct()
    one, two = grams.toDF("id_a", "grams_a"), grams.toDF("id_b", "grams_b")
    checked = found.join(one, "id_a").join(two, "id_b").select("id_a", "id_b", common_grams("grams_a", "grams_b").alias("v"))
    jaccard = F.col("v.shared") / (F.col("v.in_a") + F.col("v.in_b") - F.col("v.shared"))
    return checked.select("id_a", "id_b", jaccard.alias("jaccard")).where(F.col("jaccard") >= similarity)
