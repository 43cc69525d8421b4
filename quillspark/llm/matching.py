"""Records of two sources that describe the same work, matched without a common key by sorted neighbourhoods."""

from __future__ import annotations

import functools
import heapq
import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.names import TITLES, _one_edit, plain
from quillspark.llm.shingles import RARITY_BITS, _hashes, rarity
from quillspark.runtime import join_bounded, materialize, ship_package, spread

#: Rows on each side of the rows of one key, in one sort order, with which they are compared.
WINDOW = 20
#: Rows of a sorted run that one task compares.
RUN_ROWS = 100_000
#: Confidence from which two records are taken for one work.
MATCH = 0.5
#: Words that feeds add to a title, and words in author lines that name nobody.
ADDED = {"preprint", "pdf", "v1", "v2", "v3", "v4", "draft", "extended", "abstract", "manuscript", "accepted", "poster"}
NOBODY = {"anonymous", "others", "et", "al", "and", "von", "van", "der", "de", "la", "unknown", "n", "a"}
_MARKUP = re.compile(r"<[^<>]*>|\\[a-z]+\{|[{}$]")
_WORDS = re.compile(r"[^\W_]+")


def title_words(title: str | None) -> list[str]:
    """Words of a title without markup, marks, case and the words that feeds add; an added word that is all stays."""
    text = unicodedata.normalize("NFKC", _MARKUP.sub("", html.unescape(title or "")))
    found = [plain(w) for w in _WORDS.findall(text)]
    return [w for w in found if w not in ADDED] or found


def family_words(authors: str | None) -> set[str]:
    """Words of four letters or more in an author line: family and full given names, without titles and particles."""
    found = {plain(w) for w in _WORDS.findall(unicodedata.normalize("NFKC", authors or ""))}
    return {w for w in found if len(w) >= 4 and w not in NOBODY and w not in TITLES and not w.isdigit()}


@functools.lru_cache(1 << 17)
def _letters(word: str) -> int:
    """The different letters of a word as bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


def sort_keys(words: list[str], people: set[str], year: int | None) -> list[str]:
    """Composite sort keys of a record. Each is spoilt by another fault: a changed beginning, a cut end, a typo in a
    long word, missing or shuffled authors, a missing year."""
    content = [w for w in words if len(w) > 3]
    long = sorted(content, key=lambda w: (-len(w), w))
    names = sorted(people)
    when = str(year) if year is not None else "~"
    keys = [
        " ".join(content),
        " ".join(reversed(content)),
        " ".join(long),
        " ".join(sorted(content)),
        " ".join([*names[:3], *content[:3]]) if names else "",
        " ".join([*reversed(names[-2:]), when, *reversed(content[-2:])]) if names else "",
    ]
    return keys


class Scorer:
    """Weighted field similarities of two records. Word weights come from the counts of all titles of the larger source."""

    def __init__(self, counts: np.ndarray, total: int):
        self.counts, self.total = counts, total
        self.known: dict[str, float] = {}

    def weights(self, words: list[str]) -> list[float]:
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) > 1 << 18:
                self.known.clear()
                new = words
            at = (_hash_of(new) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)
            for w, c in zip(new, self.counts[at]):
                self.known[w] = min(8.0, math.log((self.total + 1) / (1 + c)) + 0.05)
        return [self.known[w] for w in words]

    def coverage(self, a: list[str], b: list[str]) -> tuple[float, float]:
        """Shares of the weight of each title that the other holds; words may differ by one edit, a last word may be cut."""
        wa, wb = self.weights(a), self.weights(b)
        left = dict.fromkeys(range(len(b)))
        places: dict[str, list[int]] = {}
        for j in range(len(b) - 1, -1, -1):
            places.setdefault(b[j], []).append(j)
        marks = [_letters(y) for y in b]
        both = rest = 0.0
        for i, x in enumerate(a):
            same = places.get(x)
            if same:
                hit = same[-1]
            else:
                last, size, mark, hit = i == len(a) - 1, len(x), _letters(x), None
                for j in left:  # an edit changes at most two letters of a word's set of letters
                    y = b[j]
                    if (size >= 4 and len(y) >= 4 and -1 <= size - len(y) <= 1 and (mark ^ marks[j]).bit_count() <= 2 and _one_edit(x, y)) or (last and y.startswith(x)):
                        hit = j
                        break
            if hit is None:
                rest += wa[i]
            else:
                both += wb[hit]
                del left[hit]
                places[b[hit]].remove(hit)
        return both / max(both + rest, 1e-9), both / max(both + sum(wb[j] for j in left), 1e-9)

    def confidence(self, r: tuple, p: tuple) -> float:
        """Confidence from 0 to 1 that a harvested record and a stored one describe the same work.

        Titles decide: equal up to small faults, or one cut or lacking a part of the other. Authors must then agree
        unless they are missing; the weaker the title, the more they must. Years may differ by one. A common DOI
        adds to a confidence but cannot make a match.
        """
        gap = None if r[2] is None or p[2] is None else abs(r[2] - p[2])
        if gap is not None and gap > 1:
            return 0.0
        cr, cp = self.coverage(r[0], p[0])
        low, high = min(cr, cp), max(cr, cp)
        people = len(r[1] & p[1]) / min(len(r[1]), len(p[1])) if r[1] and p[1] else None
        if low >= 0.85:
            base = 0.9 if people is None else 0.8 + 0.18 * people
        elif cr >= 0.85 and cp >= 0.35:  # a part of the stored title
            base = (0.62 if cp >= 0.6 else 0.4) if people is None else (0.45 + 0.45 * people if people >= 0.3 else 0.3)
        elif cp >= 0.85 and cr >= 0.4:  # the stored title and more
            base = 0.4 if people is None else 0.35 + 0.5 * people
        elif low >= 0.75 and people is not None and people >= 0.5:
            base = 0.35 + 0.4 * people
        else:
            base = 0.5 * high * low
        base -= 0.04 * (gap or 0)
        if r[3] and r[3] == p[3]:
            base += 0.1 * (1 - base)
        return max(0.0, min(1.0, base))


def _hash_of(words: list[str]) -> np.ndarray:
    from quillspark.llm.shingles import _MIX, mix

    with np.errstate(over="ignore"):
        return mix(_hashes(words))


def _fields(df: DataFrame) -> DataFrame:
    """Rows (src, id, title, people, year, doi) with the fields that are compared, brought to one spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, ids, titles, authors, years, dois = (c.to_pylist() for c in b.columns)
            title = [" ".join(title_words(t)) for t in titles]
            people = [" ".join(sorted(family_words(a))) for a in authors]
            mark = [re.sub(r"^(https?://doi\.org/|doi:)\s*", "", (d or "").strip().lower()) or None for d in dois]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int32()), pa.array(ids, pa.int64()), pa.array(title, pa.string()), pa.array(people, pa.string()), pa.array(years, pa.int32()), pa.array(mark, pa.string())], ["src", "id", "title", "people", "year", "doi"])

    return df.select("src", "id", "title", "authors", "year", "doi").mapInArrow(run, "src int, id bigint, title string, people string, year int, doi string")


def _marks(words) -> tuple[int, int]:
    """Words as bits of two 64-bit numbers, one bit each in either. Of two sets, every bit that one has and the other lacks is
    a word that they do not share, so few common words can be ruled out without looking at them."""
    one = two = 0
    for x in _hash_of(list(words)).tolist() if words else ():
        one |= 1 << (x & 63)
        two |= 1 << (x >> 6 & 63)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (one, two))


def _keyed(df: DataFrame, scorer) -> DataFrame:
    """(k, key, src, id, year, heavy, heavy2, heavies, names) of rows of :func:`_fields`: one row per sort key that is not empty, with
    the bits and the number of the heavy title words and the bits of the people."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer.value
        for b in batches:
            at, ks, keys, marks = [], [], [], []
            for i, (title, people, year) in enumerate(zip(*(b.column(n).to_pylist() for n in ("title", "people", "year")))):
                heavy = _heavy(score, title.split())
                mark = (*_marks(heavy), len(heavy), _marks(people.split())[0])
                for k, key in enumerate(sort_keys(title.split(), set(people.split()), year)):
                    if key:
                        at.append(i)
                        ks.append(k)
                        keys.append(key)
                        marks.append(mark)
            if at:
                own = b.select(["src", "id", "year"]).take(pa.array(at))
                bits = [pa.array(x, kind) for x, kind in zip(zip(*marks), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(keys, pa.string()), *own.columns, *bits], ["k", "key", *own.schema.names, "heavy", "heavy2", "heavies", "names"])

    return df.select("src", "id", "title", "people", "year").mapInArrow(run, "k int, key string, src int, id bigint, year int, heavy bigint, heavy2 bigint, heavies int, names bigint")


def _ranked(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows in one global order with their run and their place in the order, and the number of runs; their keys are now
    hashes, which only tell equal keys from others. The runs are the ranges
    of a range partitioning, so the order is never gathered in one task; only one count a run is added up. Equal keys are
    ordered by a hash, which mixes the sources."""
    runs = max(1, -(-rows.count() // RUN_ROWS))
    rows = rows.withColumn("mixed", F.xxhash64("src", "id"))
    order = ("k", "key", "mixed", "src", "id")
    ordered = rows.repartitionByRange(runs, *order).sortWithinPartitions(*order).withColumn("key", F.xxhash64("key"))
    ordered = materialize(ordered.select(F.spark_partition_id().alias("run"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "*").drop("mixed"), "sorted-runs")
    before = F.sum("count").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))  # one row a run
    starts = materialize(ordered.groupBy("run").count().select("run", F.coalesce(before, F.lit(0)).alias("start")), "run-starts")
    placed = join_bounded(ordered, starts, "run", "inner", runs, 24)
    return placed.withColumn("place", F.col("start") + F.col("at")).drop("start"), runs


def _spilled(ordered: DataFrame, runs: int, window: int) -> DataFrame:
    """(task, columns of ordered): rows that a later run needs: the ``window`` rows before it, and the ``window`` rows before
    the block of equal keys in which it begins, wherever that block begins. Runs and rows meet by stretches of ``window``
    places, two or three for each run, so no row is compared with all runs."""
    heads = materialize(ordered.where("at = 0 and place > 0").select(F.col("run").alias("task"), F.col("place").alias("start"), "k", "key"), "run-heads")
    first = join_bounded(ordered.select("k", "key", "place"), heads, ["k", "key"], "inner", runs, 160).groupBy("task", "start").agg(F.min("place").alias("block"))
    ranges = first.select("task", F.explode(F.array_distinct(F.array("start", "block"))).alias("high")).withColumn("low", F.col("high") - window)
    ranges = ranges.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("low") / window), F.floor((F.col("high") - 1) / window))))
    met = join_bounded(ordered.withColumn("stretch", F.floor(F.col("place") / window)), materialize(ranges, "run-needs"), "stretch", "inner", 6 * runs, 48)
    return met.where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")) & (F.col("run") < F.col("task"))).select("task", *ordered.columns).distinct()


#: Rows of one source and key that one task pairs with as many of the other.
BLOCK_ROWS = 1_000


def _equal_keys(rows: DataFrame) -> DataFrame:
    """(p, r) of the two sources with an equal sort key, each once. Frequent keys are split into blocks on both sides, and
    every block of one side meets every block of the other."""
    keyed = materialize(rows.select("src", "id", "year", F.xxhash64("k", "key").alias("h")), "match-hashes")
    sizes = keyed.groupBy("h").agg(*[F.ceil(F.sum((F.col("src") == s).cast("long")) / BLOCK_ROWS).cast("int").alias(n) for s, n in ((0, "np"), (1, "nr"))]).where("np > 0 and nr > 0")
    met = keyed.join(sizes, "h")
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = met.where("src = 0").select("h", part("np").alias("bp"), all_of("nr").alias("br"), F.col("id").alias("p"), F.col("year").alias("yp"))
    r = met.where("src = 1").select("h", all_of("np").alias("bp"), part("nr").alias("br"), F.col("id").alias("r"), F.col("year").alias("yr"))
    near = F.coalesce(F.abs(F.col("yp") - F.col("yr")) <= 1, F.lit(True))
    return p.join(r, ["h", "bp", "br"]).where(near).select("p", "r").distinct()


def _heavy(score: Scorer, words: list[str]) -> frozenset:
    return frozenset(w for w, x in zip(words, score.weights(words)) if x > 2.0)


def _row(score: Scorer, title: str, people: str, year: int | None, doi: str | None) -> tuple:
    words = title.split()
    return words, frozenset(people.split()), year, doi, _heavy(score, words)


def _confident(score: Scorer, r: tuple, p: tuple) -> float:
    """The confidence of a record and a paper, 0 if they have too few heavy words and people in common."""
    heavy = len(r[4] & p[4])
    if not (heavy or r[1] & p[1]) or 2 * heavy < min(len(r[4]), len(p[4])) - 1:
        return 0.0
    return score.confidence(r, p)


def match_records(papers: DataFrame, records: DataFrame, window: int = WINDOW, least: float = MATCH) -> DataFrame:
    """(paper_id, record_id, confidence) of the pairs with a confidence of at least ``least``.

    Both tables come as (id, title, authors, year, doi), authors in one line. Rows of a source with equal fields are
    collapsed first and expanded at the end. The collapsed rows are sorted by several composite keys; rows of different
    sources with an equal key are all compared, and each row is also compared with the ``window`` rows before the first
    row of its key. Pairs are scored by weighted field similarities. Runs overlap by what their rows need, so no pair is
    lost at their ends. A record may match several papers and the other way round; null fields take no part; rows with a
    null id are left out; repeated rows give one pair. Records without title and authors have no key and match nothing.
    """
    ship_package(papers.sparkSession)
    fields = [F.col("id").cast("bigint").alias("id"), "title", "authors", F.col("year").cast("int").alias("year"), "doi"]
    both = papers.select(F.lit(0).alias("src"), *fields).unionByName(records.select(F.lit(1).alias("src"), *fields)).where("id is not null")
    cleaned = materialize(_fields(spread(both)), "match-fields")
    titles = cleaned.where(F.col("src") == 0).where(F.exists(F.split("title", " "), lambda w: F.length(w) > 3))
    total = titles.count()
    scorer = papers.sparkSession.sparkContext.broadcast(Scorer(rarity(titles, "title", 1), total))
    copies = ["src", "title", "people", "_year", "_doi"]
    cleaned = cleaned.withColumns({"_year": F.coalesce(F.col("year").cast("string"), F.lit("")), "_doi": F.coalesce("doi", F.lit(""))})
    unique = materialize(cleaned.groupBy(*copies).agg(F.min("id").alias("id"), F.first("year").alias("year"), F.first("doi").alias("doi")), "match-unique")
    # one id may stand in several rows that differ, so collapsed rows are named by a number of their own
    unique = materialize(unique.withColumn("one", F.monotonically_increasing_id()), "match-numbered")
    members = materialize(cleaned.select(*copies, F.col("id").alias("member")).join(unique.select(*copies, "one"), copies).select("src", "one", "member").distinct(), "match-members")
    numbered = unique.select("src", F.col("one").alias("id"), "title", "people", "year", "doi")
    rows = materialize(_keyed(numbered, scorer), "match-keys")
    ordered, runs = _ranked(rows)
    own = ordered.select(F.col("run").alias("task"), "*")
    if runs > 1:
        own = own.unionByName(_spilled(ordered, runs, window))
    kinds = "paper_id bigint, record_id bigint, confidence double"

    def batch(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
        a, r, c = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(r, pa.int64()), pa.array(c, pa.float64())], ["paper_id", "record_id", "confidence"])

    def neighbours(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Pairs of one task's rows that may match: each of its own rows with the ``window`` rows before the first of its key."""
        run, k, key, src, ids, heavy, second, size, names = (t.column(n).to_numpy() for n in ("run", "k", "key", "src", "id", "heavy", "heavy2", "heavies", "names"))
        year = t.column("year").cast(pa.float64()).to_numpy()
        at = np.arange(len(k))
        new_k = np.r_[True, k[1:] != k[:-1]]
        block = np.maximum.accumulate(np.where(new_k | np.r_[True, key[1:] != key[:-1]], at, 0))
        floor = np.maximum.accumulate(np.where(new_k, at, 0))
        mine = np.flatnonzero(run == t.column("task")[0].as_py())  # rows before the run have been compared in their own
        heavy, second, names = heavy.view(np.uint64), second.view(np.uint64), names.view(np.uint64)
        lacks = lambda i, j: np.maximum(np.bitwise_count(heavy[i] & ~heavy[j]), np.bitwise_count(second[i] & ~second[j]))
        found = []
        for step in range(1, window + 1):
            i, j = mine, block[mine] - step
            ok = j >= floor[i]
            i, j = i[ok], j[ok]
            ok = (src[i] != src[j]) & ~(np.abs(year[i] - year[j]) > 1)
            i, j = i[ok], j[ok]
            most = np.minimum(size[i] - lacks(i, j), size[j] - lacks(j, i))
            ok = (2 * most >= np.minimum(size[i], size[j]) - 1) & ((most > 0) | ((names[i] & names[j]) != 0))
            i, j = i[ok], j[ok]
            found.append(np.where(src[i] == 0, [ids[i], ids[j]], [ids[j], ids[i]]).T)
        pairs = np.unique(np.concatenate(found), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["p", "r"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            task = b.column("task").to_numpy()
            cuts = np.r_[0, np.flatnonzero(task[1:] != task[:-1]) + 1, len(task)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and held[0].column("task")[0].as_py() != task[lo]:
                    yield from neighbours(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from neighbours(pa.Table.from_batches(held))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer.value
        for b in batches:
            found, known = [], {}  # a paper or record stands in several pairs of a batch
            for p, r, *x in zip(*(c.to_pylist() for c in b.columns)):
                one, two = known.get(p), known.get(r)
                if one is None:
                    one = known[p] = _row(score, *x[:4])
                if two is None:
                    two = known[r] = _row(score, *x[4:])
                c = _confident(score, two, one)
                if c >= least:
                    found.append((p, r, c))
            if found:
                yield batch(found)

    side = lambda src, name: numbered.where(F.col("src") == src).select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("title", "people", "year", "doi")])
    near = own.repartition(max(runs, 12), "task").sortWithinPartitions("task", "place").mapInArrow(compare, "p bigint, r bigint")
    met = _equal_keys(rows).unionByName(near).distinct().join(side(0, "p"), "p").join(side(1, "r"), "r").select("p", "r", *[f"{n}_{c}" for n in ("p", "r") for c in ("title", "people", "year", "doi")])
    pairs = materialize(met.mapInArrow(verify, kinds), "match-found")
    expand = lambda src, name, new: members.where(F.col("src") == src).select(F.col("one").alias(name), F.col("member").alias(new))
    full = pairs.join(expand(0, "paper_id", "p"), "paper_id").join(expand(1, "record_id", "r"), "record_id")
    return full.groupBy(F.col("p").alias("paper_id"), F.col("r").alias("record_id")).agg(F.max("confidence").alias("confidence"))


def _assign(group: pd.DataFrame) -> pd.DataFrame:
    """One-to-one pairs of largest total confidence in one component, by shortest augmenting paths with potentials. Only the
    given pairs are kept, so memory grows with them; a record may stay alone at no gain."""
    near: dict[int, dict[int, float]] = {}
    for p, r, c in zip(group["paper_id"].tolist(), group["record_id"].tolist(), group["confidence"].tolist()):
        near.setdefault(r, {})[p] = max(c, near.get(r, {}).get(p, 0.0))
    owner: dict[int, int] = {}  # of each paper
    mine: dict[int, int] = {}  # the paper of each record that has one
    u, v = {r: -max(m.values()) for r, m in near.items()}, {}
    for root in sorted(near):
        # least reduced cost of reaching each paper; to end at a record, which then stays alone, costs its potential
        far, came, done, queue = {}, {}, set(), []
        reach, base, end = {root: 0.0}, root, None
        best_end, alone = -u[root], root
        while True:
            for p, c in near[base].items():
                d = reach[base] - c - u[base] - v.get(p, 0.0)
                if p not in done and d < far.get(p, math.inf) - 1e-12:
                    far[p], came[p] = d, base
                    heapq.heappush(queue, (d, p))
            while queue and (queue[0][1] in done or queue[0][0] > far[queue[0][1]] + 1e-12):
                heapq.heappop(queue)
            if not queue or queue[0][0] >= best_end:
                break
            d, p = heapq.heappop(queue)
            done.add(p)
            if p not in owner:
                best_end, end = d, p
                break
            base = owner[p]
            reach[base] = d
            if d - u[base] < best_end:
                best_end, alone = d - u[base], base
        for r, d in reach.items():
            u[r] += best_end - d
        for p in done:
            v[p] = v.get(p, 0.0) - max(0.0, best_end - far[p])
        if end is None:  # the record at which the cheapest path ends gives its paper up
            if alone == root:
                continue
            p = mine.pop(alone)
            del owner[p]
        else:
            p = end
        while True:  # turn the path round
            r = came[p]
            before = mine.get(r)
            owner[p], mine[r] = r, p
            if r == root:
                break
            p = before
    out = [(p, r, near[r][p]) for p, r in sorted(owner.items()) if near[r][p] > 0]
    return pd.DataFrame(out, columns=["paper_id", "record_id", "confidence"])


#: Pairs from which a component is dealt to the tasks apart from the smaller ones; it is assigned in the same way.
EXACT_PAIRS = 20_000


def assign_one_to_one(pairs: DataFrame) -> DataFrame:
    """(paper_id, record_id, confidence): every paper and record at most once, total confidence maximal in each connected
    component, whatever its size. A component is assigned in one task, whose memory grows with the component's pairs."""
    pairs = materialize(pairs, "match-pairs")
    linked = components(pairs.select((-F.col("paper_id") - 1).alias("a"), F.col("record_id").alias("b")), "a", "b")
    tied = materialize(pairs.withColumn("node", F.col("record_id")).join(linked, "node").select("component", "paper_id", "record_id", "confidence"), "match-components")
    sizes = tied.groupBy("component").count()
    sizes = materialize(sizes, "match-sizes")
    of = lambda rule: tied.join(sizes.where(rule).select("component"), "component", "left_semi")
    out = of(F.col("count") == 1).select("paper_id", "record_id", "confidence")  # a pair alone is its own assignment
    # small rows but much work a component: a fixed number of partitions, which are not put together
    tasks = max(48, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for rule in (F.col("count").between(2, EXACT_PAIRS), F.col("count") > EXACT_PAIRS):
        some = of(rule).repartition(tasks, "component").groupBy("component")
        out = out.unionByName(some.applyInPandas(lambda g: _assign(g), "paper_id bigint, record_id bigint, confidence double"))
    return out
