"""Evaluation passages inside a training corpus: prefix-filtered set join over word shingles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shingles import parts, shingle_stream
from quillspark.runtime import BROADCAST_BYTES, materialize, ship_package, small_enough, spread


#: Bytes that one item shingle takes in the broadcast of a block of items.
GRAM_BYTES = 32


def shingle_rows(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(id, gram, pos): every n-word shingle of every text with its word position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, 1):
                s, d, p = shingle_stream(part.column(1).to_pylist(), n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(s.view(np.int64)), pa.array(p.astype(np.int32))], ["id", "gram", "pos"])

    return df.select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, "id bigint, gram bigint, pos int")


def _hits(docs: DataFrame, doc: str, text: str, n: int, grams: np.ndarray) -> DataFrame:
    """(doc, grams, places): of every text the shingles that stand in the sorted ``grams``, in reading order, with their word
    positions; texts without any give no row."""
    wanted = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for b in batches:
            for part in parts(b, 1):
                s, d, p = shingle_stream(part.column(1).to_pylist(), n)
                at = np.searchsorted(known, s)
                at[at == len(known)] = 0
                hit = known[at] == s
                s, d, p = s[hit], d[hit], p[hit]
                if len(s):
                    own, size = np.unique(d, return_counts=True)
                    ends = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.ListArray.from_arrays(ends, pa.array(s.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(p.astype(np.int32)))], ["doc", "grams", "places"])

    rows = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("bigint"), F.col(text).cast("string"))
    return spread(rows).mapInArrow(run, "doc bigint, grams array<bigint>, places array<int>")


class Lookup:
    """A block of items: their shingles in reading order, and the few shingles by which each is looked up."""

    def __init__(self, n: int, share: float, run: int, lists: dict[int, list[int]], by_share: dict[int, list[int]], by_run: dict[int, list[int]]):
        self.n, self.run, self.lists = n, run, lists
        self.by_share, self.by_run = by_share, by_run
        self.places: dict[int, dict[int, list[int]]] = {}
        for i, grams in lists.items():
            at = self.places.setdefault(i, {})
            for k, g in enumerate(grams):
                at.setdefault(g, []).append(k)
        self.need = {i: int(np.ceil(len(at) * share - 1e-9)) for i, at in self.places.items()}

    def candidates(self, grams: list[int], places: list[int]) -> set[int]:
        """Items that a document may hold. Length bound: it must have as many different item shingles as are needed.
        Positional bound: a lookup by run counts only in a row of neighbouring shingles as long as a shared passage's."""
        own = set(grams)
        out = {i for g in own.intersection(self.by_share) for i in self.by_share[g] if len(own) >= self.need[i]}
        span, start = self.run - self.n + 1, 0
        for k in range(1, len(places) + 1):
            if k == len(places) or places[k] != places[k - 1] + 1:
                if k - start >= span:
                    for g in grams[start:k]:
                        out.update(self.by_run.get(g, ()))
                start = k
        return out

    def verify(self, i: int, grams: list[int], places: list[int]) -> tuple[int, int, int, float] | None:
        """(shared shingles, shingles of the item, longest common run in words, best window), or None if it is no case."""
        at, before, last, longest, matched = self.places[i], {}, -2, 0, []
        for p, g in zip(places, grams):
            here = at.get(g)
            if here is None:
                continue
            matched.append((p, g))
            before = {k: before.get(k - 1, 0) + 1 for k in here} if p == last + 1 else dict.fromkeys(here, 1)
            last, longest = p, max(longest, max(before.values()))
        shared, words = len({g for _, g in matched}), longest + self.n - 1
        if not matched or (words < self.run and shared < self.need[i]):
            return None
        inside, start, best = Counter(), 0, 0
        for p, g in matched:  # different shingles inside a window as long as the item
            inside[g] += 1
            while matched[start][0] <= p - len(self.lists[i]):
                inside[matched[start][1]] -= 1
                if not inside[matched[start][1]]:
                    del inside[matched[start][1]]
                start += 1
            best = max(best, len(inside))
        return shared, len(at), words, best / len(at)


def contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", n: int = 3, share: float = 0.6, run: int = 12) -> DataFrame:
    """(doc_id, item_id, shared, item_grams, containment, longest_run, best_window): documents that hold at least ``run``
    consecutive words of an item in a row, or at least ``share`` of its distinct n-word shingles. best_window is the largest
    share of the item's shingles inside a window of the item's length; it can be smaller than the containment, which counts
    the whole document.

    Item shingles are ordered by their count over the whole corpus. An item is looked up by its rarest ones only: as
    many as make missing them all incompatible with ``share``, and the rarest of each window of ``run`` words, so that a
    shared passage cannot be missed. Candidates that pass the length and positional bounds are verified exactly. Items with
    the same text are looked up once. The items are broadcast in blocks of bounded size, one after the other, and no
    document is shuffled or compared with another, so copies need no care. Null texts and texts under n words hold nothing;
    items shorter than ``run`` words match by share only. Repeated rows count once.
    """
    ship_package(docs.sparkSession)
    span = run - n + 1
    named = materialize(items.where(F.col(item).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null").distinct(), "items")
    # one id may stand in rows of different texts, so texts are named by a number of their own
    numbered = materialize(named.select("text").distinct().withColumn("i", F.monotonically_increasing_id()), "item-texts")
    every = materialize(shingle_rows(numbered, "i", text="text", n=n).withColumnRenamed("id", "i"), "item-grams")
    blocks = max(1, -(-every.count() * GRAM_BYTES // BROADCAST_BYTES))
    found = None
    for block in range(blocks):
        item_pos = every.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)
        part = _block(docs, item_pos, doc, text, n, share, run, span)
        found = part if found is None else found.unionByName(part)
    full = found.join(F.broadcast(named.join(numbered, "text").select("i", "item")) if small_enough(named.count(), 48) else named.join(numbered, "text").select("i", "item"), "i")
    out = full.groupBy("doc", "item").agg(F.max(F.struct((F.col("shared") / F.col("size")).alias("containment"), "longest_run", "best_window", "shared", "size")).alias("x"))
    return out.select(F.col("doc").alias(doc), F.col("item").alias(item), "x.shared", F.col("x.size").alias("item_grams"), "x.containment", "x.longest_run", "x.best_window")


def _block(docs: DataFrame, item_pos: DataFrame, doc: str, text: str, n: int, share: float, run: int, span: int) -> DataFrame:
    """(doc, i, shared, size, longest_run, best_window) of one block of items, (i, gram, pos), small enough to broadcast."""
    session = docs.sparkSession
    kinds = "doc bigint, i bigint, shared bigint, size bigint, longest_run int, best_window double"
    grams = np.sort(item_pos.select("gram").distinct().toArrow().column(0).to_numpy().view(np.uint64))
    if not len(grams):
        return session.createDataFrame([], kinds)
    hits = materialize(_hits(docs, doc, text, n, grams), "item-hits")
    counts = hits.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("docs"))
    placed = materialize(item_pos.join(counts, "gram", "left").withColumn("order", F.struct(F.coalesce("docs", F.lit(0)).alias("c"), "gram")), "item-order")
    sizes = Window.partitionBy("i")
    first = placed.groupBy("i", "gram").agg(F.min("order").alias("order"))
    ranked = first.withColumn("place", F.row_number().over(sizes.orderBy("order"))).withColumn("size", F.count(F.lit(1)).over(sizes))
    by_share = ranked.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1)
    window = sizes.orderBy("pos").rowsBetween(0, span - 1)
    windows = placed.withColumn("least", F.min("order").over(window)).withColumn("width", F.count(F.lit(1)).over(window))
    by_run = windows.where(F.col("width") == span).select("i", F.col("least.gram").alias("gram")).distinct()

    def lists(df: DataFrame, key: str, value: str) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for k, v in zip(*(c.to_pylist() for c in df.select(key, value).toArrow().columns)):
            out.setdefault(k, []).append(v)
        return out

    lookup = session.sparkContext.broadcast(Lookup(n, share, run, lists(placed.orderBy("i", "pos"), "i", "gram"), lists(by_share, "gram", "i"), lists(by_run, "gram", "i")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = lookup.value
        for b in batches:
            out = []
            for d, own, places in zip(*(c.to_pylist() for c in b.columns)):
                for i in items.candidates(own, places):
                    got = items.verify(i, own, places)
                    if got:
                        out.append((d, i, *got))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["doc", "i", "shared", "size", "longest_run", "best_window"])

    return hits.mapInArrow(verify, kinds)
