"""Lexical, dense and combined retrieval over a document table, for one query or a table of queries.

Documents are rows (doc, text, ...) with a unique doc; queries are rows (query_id, query). Lexical scores are products of
two sparse tables, weights of terms in documents and in queries. :func:`best_products` and :func:`product_totals` add up the
postings of each query's terms in blocks of documents, with the queries broadcast, and let no more than the k best of a
query or its sums leave the task; where every score is wanted, or the queries pass the broadcast bound, the same product
is a join and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.signals import HYBRID_WEIGHTS, document_signals, query_signals, weighted
from quillspark.functions.text import lexical_tokens, word_tokens
from quillspark.operators.ranking import max_normal, top_k
from quillspark.operators.joins import skew_join
from quillspark.runtime import join_bounded, materialize, small_enough

#: English function words left out of weighted terms unless the caller gives a list of their own.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when "
    "where which while who whom why will with would you your yours yourself yourselves"
).split()
K1, B = 1.5, 0.75
#: Documents of one block of the product, and queries whose best leave a task together.
BLOCK_DOCS, QUERY_ROWS = 16384, 1024
#: A term that at least one in so many documents of a block has is kept as a full row of the block.
FULL_ROW = 16


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc, tf, length): lexical terms of every document. Null and empty texts have none."""
    terms = docs.select("doc", lexical_tokens(F.col("text")).alias("t")).select("doc", F.size("t").alias("length"), F.explode("t").alias("term"))
    return terms.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """One row: documents, and their mean length in lexical terms."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(lexical_tokens(F.col("text")))).alias("mean_length"))


def bm25_idf(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, df, idf): always positive inverse document frequency of every term."""
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): blank queries have none, repeated terms count each time."""
    return queries.select("query_id", F.explode(lexical_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def best_products(parts: DataFrame, weights: DataFrame, k: int, bonus: str | None = None) -> DataFrame:
    """(query_id, doc, score): the k documents with the largest sum of x times w, for every query; ties to the smaller doc.

    ``parts`` is (doc, term, x), ``weights`` (query_id, term, w), both positive and unique by their first two columns; only
    documents that share a term count. ``bonus`` names a column of ``parts``, one value per document, that is added to its
    scores. Sums are rounded to 9 places. The weights are broadcast under a size check, as is the work of a task bounded by
    blocks of documents and queries; beyond the bound the product is a join with a sum.
    """
    extra = F.col(bonus) if bonus else F.lit(0.0)
    if not small_enough(weights.count(), 48):
        plain = parts.select("doc", "term", "x", extra.alias("_bonus")).join(weights, "term")
        full = plain.groupBy("query_id", "doc").agg((F.round(F.sum(F.col("x") * F.col("w")), 9) + F.first("_bonus")).alias("score"))
        return top_k(full, "query_id", k).drop("rank")
    own, shared, back = _sides(parts, weights, extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value[0]
        n = len(starts) - 1
        held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n
        bar = np.full(n, -np.inf)  # a score below it is not among the k best of this task
        for ids, plus, scores in _products(batches, shared.value):
            for q, s in scores:
                v = s + plus if bonus else s
                at = np.flatnonzero((v >= bar[q] - 1e-8) & (s > 0))
                if not len(at):
                    continue
                if len(at) > k:
                    u = v[at]
                    at = at[u >= np.partition(u, len(u) - k)[len(u) - k] - 1e-8]
                doc, got = ids[at], np.round(s[at], 9) + plus[at]
                if held[q] is not None:
                    doc, got = np.r_[held[q][0], doc], np.r_[held[q][1], got]
                if len(doc) > k:
                    first = np.lexsort((doc, -got))[:k]
                    doc, got = doc[first], got[first]
                held[q] = (doc, got)
                if len(doc) == k:
                    bar[q] = got.min()
        for lo in range(0, n, QUERY_ROWS):
            some = [(q, h) for q, h in enumerate(held[lo : lo + QUERY_ROWS], lo) if h is not None]
            if some:
                q = np.repeat(np.array([x for x, _ in some], np.int32), [len(h[0]) for _, h in some])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([h[0] for _, h in some])), pa.array(np.concatenate([h[1] for _, h in some]))], ["q", "doc", "score"])

    near = own.mapInArrow(run, "q int, doc bigint, score double")
    return top_k(near, "q", k).join(F.broadcast(back), "q").select("query_id", "doc", "score")


def product_totals(parts: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, hits, total): how many documents share a term with each query, and the sum of their scores, each rounded to 9
    places. Sides as in :func:`best_products`; no pair of query and document leaves its task."""
    if not small_enough(weights.count(), 48):
        full = parts.join(weights, "term").groupBy("query_id", "doc").agg(F.round(F.sum(F.col("x") * F.col("w")), 9).alias("score"))
        return full.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("score").alias("total"))
    own, shared, back = _sides(parts, weights, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value[0]) - 1
        hits, total = np.zeros(n, np.int64), np.zeros(n)
        for _, _, scores in _products(batches, shared.value):
            for q, s in scores:
                hits[q] += np.count_nonzero(s)
                total[q] += np.round(s, 9).sum()
        some = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(hits[some]), pa.array(total[some])], ["q", "hits", "total"])

    sums = own.mapInArrow(run, "q int, hits bigint, total double").groupBy("q").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"))
    return sums.join(F.broadcast(back), "q").select("query_id", "hits", "total")


def _sides(parts: DataFrame, weights: DataFrame, extra: Column) -> tuple[DataFrame, Broadcast, DataFrame]:
    """Postings (doc, t, x, bonus) of the query terms, sorted by document in as many partitions as there are cores; the broadcast
    queries: starts, terms and weights, with the number of terms; and (q, query_id)."""
    session = parts.sparkSession
    table = weights.toArrow().to_pandas()
    terms, term_of = np.unique(table["term"].to_numpy(), return_inverse=True)
    names, query_of = np.unique(table["query_id"].to_numpy(), return_inverse=True)
    order = np.argsort(query_of, kind="stable")
    starts = np.searchsorted(query_of[order], np.arange(len(names) + 1))
    shared = session.sparkContext.broadcast((starts, term_of[order].astype(np.int64), table["w"].to_numpy(np.float64)[order], len(terms)))
    kinds = dict(parts.dtypes)["term"], dict(weights.dtypes)["query_id"]
    numbers = session.createDataFrame([(t.item() if hasattr(t, "item") else t, i) for i, t in enumerate(terms)], f"term {kinds[0]}, t int")
    own = parts.join(F.broadcast(numbers), "term").select("doc", "t", "x", extra.cast("double").alias("bonus"))
    back = session.createDataFrame([(i, str(n) if kinds[1] == "string" else int(n)) for i, n in enumerate(names)], f"q int, query_id {kinds[1]}")
    return own.repartition(max(12, session.sparkContext.defaultParallelism), "doc").sortWithinPartitions("doc"), shared, back


def _products(batches: Iterator[pa.RecordBatch], queries: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray]]]]:
    """For each block of documents their ids, what is added to their scores, and (query, scores of all its documents) of each
    query with a posting there. The scores are valid until the next query."""
    starts, query_terms, weights, n_terms = queries
    for docs, t, x, more in _document_blocks(batches):
        ids, row, first = _numbered(docs)
        order = np.argsort(t, kind="stable")
        row, x = row[order], x[order]
        ends = np.searchsorted(t[order], np.arange(n_terms + 1))
        count = np.diff(ends)
        full = {}
        for i in np.flatnonzero(count * FULL_ROW >= len(ids)).tolist():
            full[i] = np.zeros(len(ids))
            full[i][row[ends[i] : ends[i + 1]]] = x[ends[i] : ends[i + 1]]

        def scores() -> Iterator[tuple[int, np.ndarray]]:
            s, add = np.zeros(len(ids)), np.zeros(len(ids))
            here = count[query_terms] > 0
            some = np.flatnonzero(np.add.reduceat(here, starts[:-1]) > 0) if len(query_terms) else []
            for q in some:
                s.fill(0.0)
                for i in range(starts[q], starts[q + 1]):
                    if here[i]:
                        term = query_terms[i]
                        if (line := full.get(term)) is not None:
                            np.multiply(line, weights[i], out=add)
                            np.add(s, add, out=s)
                        else:
                            lo, hi = ends[term], ends[term + 1]
                            s[row[lo:hi]] += weights[i] * x[lo:hi]
                yield q, s

        yield ids, more[first], scores()


def _numbered(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, the number of each element's, and where each begins."""
    fresh = np.r_[True, docs[1:] != docs[:-1]]
    first = np.flatnonzero(fresh)
    return docs[first], np.cumsum(fresh) - 1, first


def _document_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows sorted by document, cut between documents into blocks of about BLOCK_DOCS."""
    held: list[np.ndarray] | None = None
    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        while True:
            edges = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            if len(edges) < BLOCK_DOCS:
                break
            cut = edges[BLOCK_DOCS - 1]
            yield tuple(x[:cut] for x in held)
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield tuple(held)


def _matched(docs: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """(doc, term, tf, length): the postings of query terms, as a table. The filter comes before the count."""
    tokens = docs.select("doc", lexical_tokens(F.col("text")).alias("t")).select("doc", F.size("t").alias("length"), F.explode("t").alias("term"))
    wanted = join_bounded(tokens, terms.select("term").distinct(), "term", "left_semi", rows, 64)
    return materialize(wanted.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length")), "matched-postings")


def _bm25_sides(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, term, x) and (query_id, term, w), whose products sum up to the score."""
    terms = query_terms(queries)
    rows = terms.count()
    hit = _matched(docs, terms, rows)
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = materialize(corpus_statistics(docs), "corpus-statistics")
    weight = terms.join(df, "term").crossJoin(F.broadcast(stats.select("n_docs")))
    weight = weight.select("query_id", "term", (F.col("times") * F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))
    x = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return hit.crossJoin(F.broadcast(stats.select("mean_length"))).select("doc", "term", x.alias("x")), materialize(weight, "query-weights")


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc, score) of every document that shares a term with the query; scores are positive and rounded to 9
    places, so that equal documents tie whatever the order of the sums."""
    parts, weights = _bm25_sides(docs, queries)
    scored = join_bounded(parts, weights, "term", "inner", weights.count(), 96)
    return scored.groupBy("query_id", "doc").agg(F.round(F.sum(F.col("x") * F.col("w")), 9).alias("score"))


def bm25_totals(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, hits, total): how many rows :func:`bm25` has for each query, and the sum of their scores."""
    return product_totals(*_bm25_sides(docs, queries))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best rows of :func:`bm25` for every query, ties to the smaller doc."""
    return best_products(*_bm25_sides(docs, queries), k)


def weighted_terms(rows: DataFrame, key: str, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(key, term, tf) of words of two letters or more and their pairs, function words taken out first. A term is the 64-bit
    hash of its word or words, which keeps the rows of a large vocabulary short."""
    t = F.filter(word_tokens(F.col("text"), 2), lambda x: ~x.isin(stop_words)) if stop_words else word_tokens(F.col("text"), 2)
    words = rows.select(key, t.alias("t"))
    ones = F.transform("t", lambda w: F.xxhash64(w))
    pairs = F.when(F.size("t") > 1, F.zip_with(F.slice(F.col("t"), 1, F.size("t") - 1), F.slice(F.col("t"), 2, F.size("t")), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
    return words.select(key, F.explode(F.concat(ones, pairs)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _tfidf_sides(docs: DataFrame, queries: DataFrame, stop_words: list[str]) -> tuple[DataFrame, DataFrame]:
    """(doc, term, x) and (query_id, term, w): vectors of length 1 over smooth inverse document frequencies. The terms of the
    corpus are counted once into a table; every step reads that."""
    terms = materialize(weighted_terms(docs, "doc", stop_words), "document-terms")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    idf = materialize(idf, "term-weights")
    vocabulary = idf.count()
    weighed = terms.join(F.broadcast(idf), "term") if small_enough(vocabulary, 40) else skew_join(terms, idf, "term", "inner")
    length = weighed.groupBy("doc").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("length"))
    q = materialize(weighted_terms(queries.select("query_id", F.col("query").alias("text")), "query_id", stop_words), "query-terms")
    rows = q.count()
    used = materialize(join_bounded(idf, q.select("term").distinct(), "term", "left_semi", rows, 64), "used-terms")
    raw = q.join(used, "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("x"))
    unit = raw.join(raw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")), "query_id").select("query_id", "term", (F.col("x") / F.col("norm")).alias("w"))
    hit = join_bounded(terms, used, "term", "inner", rows, 64)
    return hit.join(length, "doc").select("doc", "term", (F.col("tf") * F.col("idf") / F.col("length")).alias("x")), materialize(unit, "query-weights")


def tfidf(docs: DataFrame, queries: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(query_id, doc, score): cosine of weighted-term vectors; query terms that no document has are ignored."""
    parts, weights = _tfidf_sides(docs, queries, stop_words)
    return join_bounded(parts, weights, "term", "inner", weights.count(), 96).groupBy("query_id", "doc").agg(F.round(F.sum(F.col("x") * F.col("w")), 9).alias("score"))


def tfidf_top(docs: DataFrame, queries: DataFrame, k: int, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """The k best rows of :func:`tfidf` for every query, ties to the smaller doc."""
    return best_products(*_tfidf_sides(docs, queries, stop_words), k)


def _bonus(docs: DataFrame, alpha: float, beta: float) -> DataFrame:
    """(doc, bonus): logarithmic citations, and the year scaled between the corpus's ends."""
    ends = docs.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    cited = alpha * F.log1p(F.greatest(F.coalesce("citation_count", F.lit(0)), F.lit(0)))
    recent = beta * F.when(F.col("year").isNull(), 0.0).when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("year") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return docs.crossJoin(F.broadcast(ends)).select("doc", (cited + recent).alias("bonus"))


def citation_recency(docs: DataFrame, queries: DataFrame, alpha: float = 0.1, beta: float = 0.2) -> DataFrame:
    """(query_id, doc, score): lexical score plus logarithmic citations and scaled year. ``docs`` also has year and
    citation_count; a null year adds nothing, a single year counts 1."""
    return bm25(docs, queries).join(_bonus(docs, alpha, beta), "doc").select("query_id", "doc", (F.col("score") + F.col("bonus")).alias("score"))


def citation_recency_top(docs: DataFrame, queries: DataFrame, k: int, alpha: float = 0.1, beta: float = 0.2) -> DataFrame:
    """The k best rows of :func:`citation_recency` for every query, ties to the smaller doc."""
    parts, weights = _bm25_sides(docs, queries)
    return best_products(parts.join(_bonus(docs, alpha, beta), "doc"), weights, k, "bonus")


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Vectors scaled to length 1 in double precision; zero vectors stay."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn("_norm", norm).withColumn(vector, F.transform(v, lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(x))).drop("_norm")


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """(query_id, doc, score): exact cosine top k for every query vector; negative scores stay, the query's own id does
    not count, ties go to the smaller doc.

    ``vectors`` has (doc, embedding), ``queries`` (query_id, embedding), all of one length; null, cut-off and zero vectors
    must be filtered before. Both sides are cut into blocks by a hash and every block of queries meets every block of rows
    in a task of its own, so neither side is gathered; one block of queries leaves the rows uncopied.
    """
    sides = queries.select(F.lit(0).alias("side"), F.col("query_id").cast("bigint").alias("id"), "embedding").unionByName(vectors.select(F.lit(1).alias("side"), F.col("doc").cast("bigint").alias("id"), "embedding"))
    sides = materialize(sides, "dense-sides")
    sizes = {r["side"]: -(-r["count"] // block) for r in sides.groupBy("side").count().collect()}
    nq, nv = max(1, sizes.get(0, 0)), max(1, sizes.get(1, 0))
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(29)), F.lit(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    q = sides.where("side = 0").select(own(nq).alias("a"), F.explode(every(nv)).alias("b"), "side", "id", "embedding")
    v = sides.where("side = 1").select(F.explode(every(nq)).alias("a"), own(nv).alias("b"), "side", "id", "embedding")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell, queries first and then rows, each by id: the queries of a cell are held."""
        now, ids, held = None, [], []
        for b in batches:
            a, c, side, at = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x = np.array(b.column(4).to_pylist(), np.float64).reshape(b.num_rows, -1)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            cuts = np.r_[0, np.flatnonzero((a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (side[1:] != side[:-1])) + 1, len(a)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if (a[lo], c[lo]) != now:
                    now, ids, held = (a[lo], c[lo]), [], []
                if side[lo] == 0:
                    ids.append(at[lo:hi]), held.append(x[lo:hi])
                elif held:
                    names, unit = np.concatenate(ids), np.concatenate(held)
                    ids, held = [names], [unit]
                    s = np.where(names[:, None] == at[None, lo:hi], -np.inf, unit @ x[lo:hi].T)
                    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    got = np.take_along_axis(s, best, 1).ravel()
                    keep = got > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best.shape[1])[keep]), pa.array(at[lo:hi][best].ravel()[keep]), pa.array(got[keep])], ["query_id", "doc", "score"])

    cells = q.unionByName(v).repartition(max(nq * nv, 1), "a", "b").sortWithinPartitions("a", "b", "side", "id")
    return top_k(cells.mapInArrow(compare, "query_id bigint, doc bigint, score double"), "query_id", k).drop("rank")


def hybrid(docs: DataFrame, queries: DataFrame, k: int, level: str = "basic_ml", now: int = 2026, dense: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, score, bm25, tfidf, dense and all signals): union of the best of each retriever, scores scaled by
    their maximum per query, mixed with the quality signals; positive scores only, k per query.

    Each retriever contributes its best max(8 k, 50). ``docs`` carries the metadata columns of the signals; ``dense`` is a
    run (query_id, doc, score) of vector search, where the queries have vectors.
    """
    width = max(8 * k, 50)
    runs = {"bm25": bm25_top(docs, queries, width), "tfidf": tfidf_top(docs, queries, width)}
    if dense is not None:
        runs["dense"] = dense
    pool = None
    for name, run in runs.items():
        best = max_normal(top_k(run, "query_id", width, tie="doc"), "query_id", "score")
        part = best.select("query_id", "doc", F.lit(name).alias("source"), F.col("normal").alias("x"))
        pool = part if pool is None else pool.unionByName(part)
    wide = pool.groupBy("query_id", "doc").agg(*[F.coalesce(F.max(F.when(F.col("source") == n, F.col("x"))), F.lit(0.0)).alias(n) for n in ("bm25", "tfidf", "dense")])
    wide = materialize(wide, "hybrid-pool")  # the pool is read for its documents and for its scores
    facts = document_signals(docs.drop("text").join(wide.select("doc").distinct(), "doc", "left_semi"), now)
    full = wide.join(facts, "doc").join(queries.select("query_id", "query"), "query_id")
    out = query_signals(full, level).withColumn("score", weighted(HYBRID_WEIGHTS)).where("score > 0")
    return top_k(out, "query_id", k, tie="doc").drop("rank")


def candidate_pool(runs: dict[str, DataFrame], k: int = 50) -> DataFrame:
    """(query_id, doc, <name>_score, <name>_rank ...): union of the top k of each run, with rank and score where it has one."""
    long = None
    for name, run in runs.items():
        part = top_k(run, "query_id", k, tie="doc").select("query_id", "doc", F.lit(name).alias("m"), "score", "rank")
        long = part if long is None else long.unionByName(part)
    return long.groupBy("query_id", "doc").agg(*[f for n in runs for f in (F.coalesce(F.max(F.when(F.col("m") == n, F.col("score"))), F.lit(0.0)).alias(f"{n}_score"), F.max(F.when(F.col("m") == n, F.col("rank"))).alias(f"{n}_rank"))])


def more_like(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(query_id, doc, score): documents like each of the given ones, by its own text; itself left out."""
    queries = docs.join(ids.select("doc").distinct(), "doc", "left_semi").select(F.col("doc").alias("query_id"), F.col("text").alias("query"))
    return top_k(bm25_top(docs, queries, k + 1).where("doc <> query_id"), "query_id", k, tie="doc").drop("rank")


def best_ranks(runs: dict[str, DataFrame], k: int) -> DataFrame:
    """(query_id, doc, methods, best_rank, mean_rank) over the top k of several runs."""
    pool = candidate_pool(runs, k)
    ranks = [F.col(f"{n}_rank") for n in runs]
    some = F.array_compact(F.array(*ranks))
    total = F.aggregate(some, F.lit(0).cast("bigint"), lambda a, x: a + x)
    names = F.array_compact(F.array(*[F.when(F.col(f"{n}_rank").isNotNull(), F.lit(n)) for n in runs]))
    return pool.select("query_id", "doc", F.array_join(names, ",").alias("methods"), F.array_min(some).alias("best_rank"), (total / F.size(some)).alias("mean_rank"))
