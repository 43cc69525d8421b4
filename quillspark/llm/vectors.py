"""Most similar vectors for every vector: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.joins import skew_join
from quillspark.runtime import materialize, release, ship_package, spread

#: The tree is fitted on a tenth of the rows, chosen by hash, but on no fewer than the first and no more than the second of
#: these numbers; every row is indexed.
SAMPLE_ROWS, MOST_SAMPLE_ROWS = 40_000, 400_000
#: Queries of the calibration, compared with all rows.
PROBES = 256
LEAF_ROWS = 200
BRANCH = 12
#: Largest block of a leaf, and of the queries that meet it, in one task.
BLOCK = 4096
QUERY_BLOCK = 1 << 16
#: Bytes of vectors that one round of the search shuffles; a bound on the disk that it takes beside its tables.
ROUND_BYTES = 64 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """Nodes of a k-means tree over unit vectors: centres, children and leaf numbers."""

    def __init__(self, sample: np.ndarray, leaves: int, branch: int = BRANCH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf = [np.zeros(sample.shape[1])], [[]], [-1]
        self.leaves = 0
        per_leaf = max(2, len(sample) // max(1, leaves))
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= per_leaf * 1.5 or len(np.unique(sample[rows], axis=0)) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            k = int(min(branch, max(2, round(len(rows) / per_leaf))))
            centre, mine = _k_means(sample[rows], k, rng)
            for c in range(len(centre)):
                self.centres.append(centre[c])
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(len(self.centres) - 1)
                todo.append((len(self.centres) - 1, rows[mine == c]))
        self.centres = np.array(self.centres)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that a plain descent reaches."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            best = kids[np.argmax(x[rows] @ self.centres[kids].T, axis=1)]
            for c in np.unique(best):
                todo.append((c, rows[best == c]))
        return out

    def visits(self, x: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` leaves in best-bin-first order: a priority queue of the unopened nodes, nearest centre first."""
        near = (x @ self.centres.T).tolist()
        most = min(most, self.leaves)
        out = np.zeros((len(x), most), np.int64)
        children, leaf = self.children, self.leaf
        for i, score in enumerate(near):
            queue, n = [(0.0, 0)], 0
            while n < most:
                _, node = heapq.heappop(queue)
                while leaf[node] < 0:  # go down, keeping the branches not taken
                    best = max(children[node], key=score.__getitem__)
                    for c in children[node]:
                        if c != best:
                            heapq.heappush(queue, (-score[c], c))
                    node = best
                out[i, n] = leaf[node]
                n += 1
        return out


def _k_means(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with spread-out starts; empty clusters are dropped."""
    centre = [x[rng.integers(len(x))]]
    far = 1 - x @ centre[0]
    for _ in range(1, k):
        p = np.maximum(far, 0)
        centre.append(x[rng.choice(len(x), p=p / p.sum())] if p.sum() > 0 else x[rng.integers(len(x))])
        far = np.minimum(far, 1 - x @ centre[-1])
    centre = np.array(centre)
    for _ in range(rounds):
        mine = np.argmax(x @ centre.T, axis=1)
        kept = np.unique(mine)
        total = np.stack([x[mine == c].sum(axis=0) for c in range(len(centre))])
        norm = np.linalg.norm(total[kept], axis=1, keepdims=True)
        centre = total[kept] / np.where(norm > 0, norm, 1)
    mine = np.argmax(x @ centre.T, axis=1)
    kept, mine = np.unique(mine, return_inverse=True)
    return centre[kept], mine


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _vectors(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel().astype(np.float32)))


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise the k largest, ties to the smaller id; ``ids`` must ascend, which makes the stable order do so."""
    k = min(k, sims.shape[1])
    if sims.shape[1] > 4 * k:
        bar = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        wide = int((sims >= bar).sum(axis=1).max())
        if wide <= 2 * k:  # few ties at the bar
            at = np.sort(np.argpartition(-sims, wide - 1, axis=1)[:, :wide], axis=1)
            order = np.argsort(-np.take_along_axis(sims, at, 1), axis=1, kind="stable")[:, :k]
            at = np.take_along_axis(at, order, 1)
            return np.take_along_axis(sims, at, 1), ids[at]
    at = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(sims, at, 1), ids[at]


def usable_vectors(df: DataFrame, key: str, vector: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(members, reps): members (id, vid) of the usable rows, one per id; reps (vid, vec) one per different vector, vid
    its smallest id. Unusable: null, another length, a null, NaN or infinite element, all zero. Of different vectors
    under one id the one with the smallest hash counts."""
    v = F.col("vec")
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vec")).where("id is not null and vec is not null")
    rows = rows.where((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = rows.select("id", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"), "vec")
    one = rows.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    least = one.groupBy("h1", "h2").agg(F.min("id").alias("vid"))
    members = materialize(one.join(least, ["h1", "h2"]).select("id", "vid"), "vector-members")
    reps = rows.join(members.where("id = vid"), "id", "left_semi").groupBy("id").agg(F.min_by("vec", F.struct("h1", "h2")).alias("vec")).withColumnRenamed("id", "vid")
    return members, materialize(reps, "vectors")


def nearest(df: DataFrame, key: str, vector: str, size: int, k: int = 10, recall: float = 0.98) -> DataFrame:
    """(id, other, similarity, place): for every usable vector the k most similar others by cosine, ties to the smaller id.

    Equal vectors are searched once: only the k + 1 smallest ids of a group of copies can be anybody's neighbour, and
    each member takes the result of its group without itself. The tree is fitted on a bounded sample; leaf visits are
    widened until, on probes compared with all rows, ``recall`` is reached. Fewer than two usable rows give no rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    members, reps = usable_vectors(df, key, vector, size)
    n = reps.count()
    # a row limit per group that Spark applies before its shuffle, too
    head = Window.partitionBy("vid").orderBy("id")
    heads = members.withColumn("r", F.row_number().over(head)).where(F.col("r") <= k + 1).groupBy("vid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    heads = materialize(heads, "vector-heads")
    if n > 1:
        found = _search(reps, n, size, k, recall)
    else:
        found = spark.createDataFrame([], "vid bigint, other bigint, similarity double")
    release(reps)
    own = heads.select("vid", F.explode("ids").alias("id"), F.lit(1.0).alias("similarity"))
    others = found.join(heads.withColumnRenamed("vid", "other"), "other").select("vid", F.explode("ids").alias("id"), "similarity")
    first = Window.partitionBy("vid").orderBy(F.desc("similarity"), "id")
    lists = own.unionByName(others).withColumn("r", F.row_number().over(first)).where(F.col("r") <= 2 * k + 1)
    lists = lists.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "id"))).alias("near"))
    met = skew_join(members, materialize(lists, "vector-lists"), "vid", "inner")
    mine = met.select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("place", "x"))
    return mine.select("id", F.col("x.id").alias("other"), (-F.col("x.far")).alias("similarity"), (F.col("place") + 1).alias("place"))


def fit_tree(reps: DataFrame, n: int) -> Tree:
    share = min(1.0, min(max(SAMPLE_ROWS, n // 10), MOST_SAMPLE_ROWS) / n)
    sample = reps.where(F.pmod(F.xxhash64("vid", F.lit(3)), F.lit(1 << 30)) <= int(share * (1 << 30))).select("vec").toArrow()
    x = _unit(_matrix(sample.column(0).combine_chunks()))
    return Tree(x, max(1, min(n // LEAF_ROWS, len(x) // 8)))


def calibrate(reps: DataFrame, tree, n: int, k: int, recall: float) -> tuple[int, list[float]]:
    """Leaf visits that reach ``recall`` on probes, and the recall of 1, 2, ... visits. The true neighbours of the probes
    come from a scan of all rows against the broadcast probes."""
    share = min(1.0, 4 * PROBES / n)
    drawn = F.pmod(F.xxhash64("vid", F.lit(5)), F.lit(1 << 30))
    rows = reps.where(drawn <= int(share * (1 << 30))).orderBy(drawn, "vid").limit(PROBES).orderBy("vid").toArrow()
    ids = rows.column("vid").to_numpy()
    probes = _unit(_matrix(rows.column("vec").combine_chunks()))
    shared = reps.sparkSession.sparkContext.broadcast((ids, probes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        for b in batches:
            vid = b.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(vid)
            vid, x = vid[order], _unit(_matrix(b.column(1))[order])
            leaf = tree.value.assign(x)
            s = np.where(own[:, None] == vid[None, :], -np.inf, q @ x.T)
            at = np.argsort(-s, axis=1, kind="stable")[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), at.shape[1])), pa.array(np.take_along_axis(s, at, 1).ravel()), pa.array(leaf[at].ravel())], ["probe", "s", "leaf"])

    best = Window.partitionBy("probe").orderBy(F.desc("s"))
    truth = reps.select("vid", "vec").mapInArrow(scan, "probe bigint, s double, leaf bigint").where("s > double('-infinity')").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("probe", "leaf").toPandas()
    order = tree.value.visits(probes, tree.value.leaves)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
    at = rank[truth["probe"].to_numpy(), truth["leaf"].to_numpy()]
    curve = np.cumsum(np.bincount(at, minlength=order.shape[1])) / max(1, len(at))
    need = int(np.searchsorted(curve, recall - 1e-12) + 1)
    return min(need, order.shape[1]), curve.tolist()


def _search(reps: DataFrame, n: int, size: int, k: int, recall: float) -> DataFrame:
    """(vid, other, similarity): the k best of the visited leaves for every vector."""
    sc = reps.sparkSession.sparkContext
    tree = sc.broadcast(fit_tree(reps, n))
    visits, _ = calibrate(reps, tree, n, k, recall)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its leaf and the leaves that it visits as a query."""
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                unit = _unit(_matrix(part.column(1)))
                seen = tree.value.visits(unit, visits)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, seen.size + 1, seen.shape[1], dtype=np.int32)), pa.array(seen.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tree.value.assign(unit).astype(np.int32)), lists], ["vid", "vec", "leaf", "seen"])

    routed = materialize(spread(reps.select("vid", "vec")).mapInArrow(route, "vid bigint, vec array<float>, leaf int, seen array<int>"), "vector-routes")
    held = np.zeros(tree.value.leaves, np.int64)
    for r in routed.groupBy("leaf").count().collect():  # no more rows than the tree has leaves
        held[r["leaf"]] = r["count"]
    group, by_row = _leaf_groups(held)
    shape = sc.broadcast((group, by_row))

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, _ = shape.value
        n = np.zeros(len(by_row), np.int64)
        for b in batches:
            n += np.bincount(_queries(_matrix(b.column(0)), group)[1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["grp", "n"])

    met = np.zeros(len(by_row), np.int64)
    for r in routed.select("seen").mapInArrow(meetings, "grp bigint, n bigint").groupBy("grp").agg(F.sum("n").alias("n")).collect():
        met[r["grp"]] = r["n"]
    by_query = np.maximum(1, -(-met // QUERY_BLOCK))
    rows_in = np.bincount(group, weights=held, minlength=len(by_row))
    load = (rows_in * by_query + met * by_row) * 4 * size  # bytes that each group of leaves makes shuffle
    rounds = int(max(1, min(-(-load.sum() // ROUND_BYTES), 2 * -(-load.sum() // (n * 4 * size)))))  # each round shuffles about half the vectors
    turn_of = (np.cumsum(load) - load) // max(1, load.sum() / rounds)
    cells = sc.broadcast((group, by_row, by_query, np.minimum(turn_of, rounds - 1).astype(np.int64)))

    def deal(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows (cell, kind, leaf, vid, vec, leaves) of one round: a leaf row goes to its block of the group, once for each
            block of queries; a query once to every block of the rows of a group that it visits, with its leaves there."""
            group, by_row, by_query, turns = cells.value
            for b in batches:
                vid, leaf, salt = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 4))
                at = np.flatnonzero(turns[group[leaf]] == turn)
                own, copy = _copies(at, by_query[group[leaf[at]]])
                g = group[leaf[own]]
                cell = (g << 40) + (salt[own] % by_row[g] << 20) + copy
                if len(own):
                    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(own) + 1, np.int32)), pa.array([], pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.zeros(len(own), np.int32)), pa.array(leaf[own]), pa.array(vid[own]), b.column(1).take(pa.array(own)), none], DEALT)
                row, g, start, leaves = _queries(_matrix(b.column(3)), group)
                keep = np.flatnonzero(turns[g] == turn)
                pick, copy = _copies(keep, by_row[g[keep]])
                if len(pick):
                    cell = (g[pick] << 40) + (copy << 20) + salt[row[pick]] % by_query[g[pick]]
                    own, sizes = row[pick], (start[1:] - start[:-1])[pick]
                    ends = np.r_[0, np.cumsum(sizes)]
                    flat = leaves[np.repeat(start[pick] - ends[:-1], sizes) + np.arange(ends[-1])]
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.ones(len(own), np.int32)), pa.array(np.full(len(own), -1, np.int32)), pa.array(vid[own]), b.column(1).take(pa.array(own)), lists], DEALT)

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, kind, leaf and id: one block of leaf rows is held, queries stream past it and meet the
        leaves that they visit; the k best of the cell go on."""
        now, held, fresh, ids, rows, ends = None, [], True, None, None, {}
        for b in batches:
            cell, kind, leaf, vid = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            x = _unit(_matrix(b.column(4)))
            seen, ends_of = b.column(5), b.column(5).offsets.to_numpy()
            seen = seen.values.to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1, len(cell)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if cell[lo] != now:
                    now, held, fresh = cell[lo], [], True
                if kind[lo] == 0:
                    held.append((leaf[lo:hi], vid[lo:hi], x[lo:hi]))
                    continue
                if not held:
                    continue
                if fresh:
                    of, ids, rows = (np.concatenate(c) for c in zip(*held))
                    held, fresh = [True], False
                    edge = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]
                    ends = {int(of[s]): (s, e) for s, e in zip(edge[:-1], edge[1:])}
                who = np.repeat(np.arange(lo, hi), np.diff(ends_of[lo : hi + 1]))
                where = seen[ends_of[lo] : ends_of[hi]]
                got = []
                for one in np.unique(where):
                    if int(one) not in ends:
                        continue
                    s, e = ends[int(one)]
                    mine = who[where == one]
                    for f in range(0, len(mine), 512):
                        q = mine[f : f + 512]
                        sims = x[q] @ rows[s:e].T
                        sims[vid[q, None] == ids[None, s:e]] = -np.inf
                        best, other = _top(sims, ids[s:e], k)
                        ok = best.ravel() > -np.inf
                        got.append((np.repeat(vid[q], best.shape[1])[ok], other.ravel()[ok], best.ravel()[ok]))
                if got:
                    v, o, s = (np.concatenate(c) for c in zip(*got))
                    order = np.lexsort((o, -s, v))
                    v, o, s = v[order], o[order], s[order]
                    first = np.r_[True, v[1:] != v[:-1]]
                    keep = np.arange(len(v)) - np.flatnonzero(first)[np.cumsum(first) - 1] < k
                    yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(o[keep]), pa.array(s[keep])], ["vid", "other", "similarity"])

    salted = routed.withColumn("salt", F.pmod(F.xxhash64("vid", F.lit(11)), F.lit(1 << 30)))
    kinds = "cell bigint, kind int, leaf int, vid bigint, vec array<float>, leaves array<int>"
    near = []
    for turn in range(rounds):
        dealt = salted.mapInArrow(deal(turn), kinds).repartition(_tasks(reps), "cell").sortWithinPartitions("cell", "kind", "leaf", "vid")
        near.append(materialize(dealt.mapInArrow(compare, "vid bigint, other bigint, similarity double"), "vector-near"))
    release(routed)
    best = Window.partitionBy("vid").orderBy(F.desc("similarity"), "other")
    found = reduce(DataFrame.unionByName, near).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("vid", "other", "similarity")
    found = materialize(found, "vector-found")
    for part in near:
        release(part)
    return found


DEALT = ["cell", "kind", "leaf", "vid", "vec", "leaves"]


def _tasks(df: DataFrame) -> int:
    return max(12, df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _leaf_groups(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each leaf and the row blocks of each group: neighbouring leaves of up to BLOCK rows together, a larger one
    alone. Leaves are numbered depth first, so neighbours lie near each other and a query visits few groups."""
    group = np.zeros(len(held), np.int64)
    totals = [0]
    for i, rows in enumerate(held.tolist()):
        if totals[-1] and totals[-1] + rows > BLOCK:
            totals.append(0)
        totals[-1] += rows
        group[i] = len(totals) - 1
    return group, np.maximum(1, -(-np.array(totals) // BLOCK))


def _queries(seen: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, group, start, leaves): each row's visited groups, and where the leaves of each begin; start has one end more."""
    row = np.repeat(np.arange(len(seen)), seen.shape[1])
    leaf = seen.ravel().astype(np.int64)
    order = np.lexsort((leaf, row))
    row, leaf = row[order], leaf[order]
    g = group[leaf]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (g[1:] != g[:-1])]) if len(row) else np.zeros(0, np.int64)
    return row[first], g[first], np.r_[first, len(row)], leaf


def _copies(at: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every element as often as told, with the number of the copy."""
    ends = np.cumsum(times)
    return np.repeat(at, times), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
