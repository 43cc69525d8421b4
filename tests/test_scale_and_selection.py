"""Paths that only large or skewed tables take, forced here by small bounds, and the operators of selection and ingest."""

import itertools
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark import runtime
from quillspark.functions import labels as L
from quillspark.operators import corpus as C
from quillspark.operators import evaluation as E
from quillspark.operators import ingest as I
from quillspark.operators import joins as J
from quillspark.operators import labelsets as B
from quillspark.operators import learning as M
from quillspark.operators import queries_selection as QS
from quillspark.operators import readers as N
from quillspark.operators import registry as G
from quillspark.operators import retrieval as R
from quillspark.operators import selection as S
from quillspark.operators.integrity import bloom_shards, orphan_references, split_by_bloom
from quillspark.operators.ranking import numbered
from quillspark.sources import pages as P
from quillspark.sources import sinks as K


def test_only_a_session_in_the_driver_may_lack_a_shared_folder(spark):
    assert runtime.in_driver("local") and runtime.in_driver("local[4]")
    assert not runtime.in_driver("local-cluster[2,1,1024]") and not runtime.in_driver("spark://h:7077")

    class Context:
        master = "spark://h:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


def test_joins_of_hot_keys(spark, monkeypatch):
    rng = random.Random(1)
    left = [(rng.choice([1, 1, 1, 2, 3, None]), i) for i in range(200)]
    right = [(1, "a"), (2, "b"), (9, "c")]
    l, r = spark.createDataFrame(left, "k bigint, i int"), spark.createDataFrame(right, "k bigint, x string")
    monkeypatch.setattr(J, "HOT_ROWS", 20)
    for how in ("left", "inner"):
        want = sorted((k, i, dict(right).get(k)) for k, i in left if how == "left" or k in dict(right)) if how == "inner" else None
        got = [tuple(x) for x in J.skew_join(l, r, "k", how).select("k", "i", "x").collect()]
        assert len(got) == (200 if how == "left" else len(want)) and (how == "left" or sorted(got) == want)
    a = spark.createDataFrame([(k or 0, i) for k, i in left], "k bigint, a int")
    b = spark.createDataFrame([(k or 0, i) for k, i in left[:60]], "k bigint, b int")
    got = sorted((x["a"], x["b"]) for x in J.block_join(a, b, "k", 7, "a", "b").collect())
    assert got == sorted((i, j) for k, i in left for m, j in left[:60] if (k or 0) == (m or 0))
    assert J.block_join(a.limit(0), b, "k", 7, "a", "b").count() == 0


def test_bloom_filter_at_every_size(spark, monkeypatch):
    p = spark.range(0, 30_000, 3).select(F.col("id").alias("key"))
    r = spark.range(30_000).select("id", F.col("id").alias("ref"))
    for bound in (64 << 20, 100):  # broadcast, and joined shard by shard
        monkeypatch.setattr("quillspark.runtime.BROADCAST_BYTES", bound)
        sure, rest = split_by_bloom(r, "ref", p, "key", 10_000)
        assert {x["id"] for x in rest.collect()} >= set(range(0, 30_000, 3)) and sure.count() > 18_000
        assert orphan_references(r, p).count() == 20_000
    shards, n = bloom_shards(p, "key", 10_000)
    assert sum(len(x["words"]) for x in shards.collect()) == n


def test_numbering_and_negatives(spark):
    d = spark.createDataFrame([(x,) for x in random.Random(2).sample(range(10_000), 500)], "v int").repartition(7)
    got = [(x["number"], x["v"]) for x in numbered(d, "v").orderBy("number").collect()]
    assert got == list(enumerate(sorted(v for _, v in got)))
    docs = spark.range(1000).select(F.col("id").alias("doc"))
    q = spark.createDataFrame([(1,), (2,), (3,)], "query bigint")
    taken = docs.where("doc >= 5").select(F.lit(1).cast("bigint").alias("query"), "doc")  # only five are free for query 1
    got = C.negatives_by_hash(q, docs, taken, 7, 5).collect()
    by = {k: {x["doc"] for x in got if x["query"] == k} for k in (1, 2, 3)}
    assert by[1] == set(range(5)) and len(by[2]) == 5 and len(by[3]) == 5 and len(got) == 15
    assert len({x["doc"] for x in C.negatives_by_hash(q, docs, taken, 7, 50).where("query = 1").collect()}) == 5
    assert C.negatives_by_hash(q.limit(0), docs, taken, 7, 5).count() == 0


def test_block_products_equal_the_join(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=12))) for i in range(150)] + [(900, None)], "doc bigint, text string")
    q = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=4))) for i in range(30)] + [("none", "zzz"), ("blank", " ")], "query_id string, query string")
    key = lambda df: sorted((x["query_id"], x["doc"], round(x["score"], 6)) for x in df.collect())
    monkeypatch.setattr(R, "BLOCK_DOCS", 17), monkeypatch.setattr(R, "QUERY_ROWS", 7)
    fast = key(R.bm25_top(docs, q, 4)), key(R.tfidf_top(docs, q, 4))
    full = key(R.top_k(R.bm25(docs, q), "query_id", 4)), key(R.top_k(R.tfidf(docs, q), "query_id", 4))
    monkeypatch.setattr("quillspark.runtime.BROADCAST_BYTES", 10)
    assert fast == full == (key(R.bm25_top(docs, q, 4)), key(R.tfidf_top(docs, q, 4))) and len(fast[0]) == 120
    assert R.bm25_top(docs.limit(0), q, 4).count() == 0 and R.bm25_top(docs, q.limit(0), 4).count() == 0
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "doc bigint, embedding array<float>")
    one = sorted((x["query_id"], x["doc"]) for x in R.dense_search(v, v.withColumnRenamed("doc", "query_id"), 3).collect())
    assert one == sorted((x["query_id"], x["doc"]) for x in R.dense_search(v, v.withColumnRenamed("doc", "query_id"), 3, block=7).collect()) and len(one) == 180


def test_registry(spark):
    assert G.method_name(" BM25 ") == "bm25" and set(G.retrievers()) == set(G.EXPLANATIONS) and G.level_name(" Advanced") == "advanced"
    for wrong in (lambda: G.method_name("magic"), lambda: G.level_name("wizard")):
        with pytest.raises(ValueError):
            wrong()
    docs = spark.createDataFrame([(1, "graph model"), (2, "other")], "doc bigint, text string")
    q = spark.createDataFrame([("a", "graph")], "query_id string, query string")
    first = G.recommend("bm25", docs, q, 2, "one")
    assert G.recommend("bm25", docs, q, 2, "one") is first and G.recommend("bm25", docs, q, 2, "two") is not first
    assert [(x["method"], x["doc"]) for x in first.collect()] == [("bm25", 1)]


def test_excerpts(spark):
    text = "1 Introduction\nFirst words.\n\nMethods\nWe use a model. The model works.\nConclusion\nDone."
    row = spark.range(1).select(
        L.heading_lines(F.lit(text)).alias("h"), L.named_section(F.lit(text), ["methods"]).alias("m"), L.named_section(F.lit(text), ["absent"]).alias("none"), L.named_section(F.lit(None).cast("string"), ["methods"]).alias("null"),
        L.best_window(F.lit("a model. xxxxxxxxxxxxxxxxxxxx model model"), F.array(F.lit("model")), 14).alias("w"), L.best_window(F.lit(""), F.array(F.lit("model")), 14).alias("no"),
    ).first()
    assert row["h"] == ["1 Introduction", "Methods", "Conclusion"] and row["m"] == "We use a model. The model works." and row["none"] is None and row["null"] is None
    assert row["w"]["hits"] == 2 and row["no"] is None


def test_selection(spark):
    rows = spark.createDataFrame([("q", i, float(i % 5), i % 2 == 0) for i in range(12)], "query_id string, doc bigint, score double, even boolean")
    got = S.bucket_selection(rows, [("even", F.col("even"), [F.desc("score"), F.asc("doc")], 2), ("any", F.lit(True), [F.asc("doc")], 3)], 4).orderBy("place").collect()
    assert [(x["doc"], x["bucket"]) for x in got] == [(4, "even"), (8, "even"), (0, "any"), (1, "any")]
    t = spark.createDataFrame([(f"t{i}", i, 1, 1, 1) for i in range(6)], "query_id string, negatives int, b0 int, b1 int, b2 int")
    s = S.balanced_splits(t, 1, 3)
    assert {*s["val"], *s["test"]} == {"t3", "t2"} and len(s["train"]) == 4
    assert S.balanced_splits(t.limit(1), 1, 3) == {"train": ["t0"], "val": [], "test": []} and S.balanced_splits(t.limit(0), 1, 3)["train"] == []
    lab = spark.createDataFrame([("q", 1, 1.0, 2, False), ("q", 2, 0.5, 1, False), ("q", 3, 0.0, 0, True)], "query_id string, doc bigint, reading double, bucket int, negative boolean")
    assert {(x["preferred"], x["rejected"], x["kind"]) for x in B.preference_pairs(lab, 10).collect()} == {(1, 2, "strong_positive_over_partial"), (1, 3, "positive_over_hard_negative"), (2, 3, "positive_over_hard_negative")}
    rows, missing = B.exact_join({"a": lab.select("query_id", "doc", "reading"), "b": lab.where("doc > 1").select("query_id", "doc", "bucket")}, ["query_id", "doc"])
    assert rows.count() == 2 and [tuple(x) for x in missing.collect()] == [("q", 1, "b")]
    w = M.sample_weights(spark.createDataFrame([("a",), ("a",), (None,)], "g string"), "g").collect()
    assert sorted(x["weight"] for x in w) == [1.5, 1.5, 3.0]


def test_pages_and_database(spark, tmp_path):
    pages = {"*": {"results": [{"id": 1, "title": "a", "abstract": "x"}, {"id": 2, "title": None, "abstract": "x"}], "meta": {"next_cursor": "b"}}, "b": {"results": [{"id": 1, "title": "a", "abstract": "x"}, {"id": 3, "title": "c", "abstract": "y"}], "meta": {"next_cursor": "b"}}}
    assert [r["id"] for r in P.cursor_pages(pages.get, 10)] == [1, 3] and [r["id"] for r in P.cursor_pages(pages.get, 1)] == [1]
    tokens = {None: {"records": [{"id": 1, "categories": ["cs.IR"]}, {"id": 2, "deleted": True}], "resumption_token": "t"}, "t": {"records": [{"id": 4, "categories": ["q-bio"]}, {"id": 5, "categories": ["cs.IR"]}]}}
    assert [r["id"] for r in P.token_pages(tokens.get, {"cs.IR"}, 10)] == [1, 5]
    landed = P.land_pages(spark, P.cursor_pages(pages.get, 10), str(tmp_path / "pages"), "id bigint, title string", 1)
    assert {(x["id"], x["title"]) for x in landed.collect()} == {(1, "a"), (3, "c")}
    assert P.land_pages(spark, iter(()), str(tmp_path / "none"), "id bigint").count() == 0
    con = sqlite3.connect(tmp_path / "db.sqlite")
    con.execute("CREATE TABLE papers (id INTEGER, title TEXT, year INTEGER)")
    con.executemany("INSERT INTO papers VALUES (?, ?, ?)", [(i, f"t{i}" if i % 3 else None, 2000 + i) for i in range(50)])
    con.execute("CREATE TABLE empty (id INTEGER)")
    con.commit(), con.close()
    got = P.read_sqlite(spark, str(tmp_path / "db.sqlite"), "papers", "id bigint, title string, year bigint", 6)
    assert sorted((x["id"], x["title"]) for x in got.where("id < 4").select("id", "title").collect()) == [(0, None), (1, "t1"), (2, "t2"), (3, None)] and got.count() == 50
    assert P.read_sqlite(spark, str(tmp_path / "db.sqlite"), "empty", "id bigint").count() == 0


def test_report_and_ingest(spark, tmp_path):
    t = spark.createDataFrame([("a|b", 1), (None, 2)], "k string, n int")
    K.write_report(spark, str(tmp_path), "my report", {"rows": 2}, {"counts": t})
    text = "\n".join(x["value"] for x in spark.read.text(str(tmp_path / "my-report.md")).collect())
    assert "## counts" in text and "a\\|b" in text
    with pytest.raises(ValueError):
        K.write_report(spark, str(tmp_path), "big", {}, {"x": t}, most=1)
    papers = spark.createDataFrame([(5, "arxiv:1", None, "Known title")], "id bigint, external_id string, doi string, title string")
    rec = [("arxiv:1", None, "Known title", ["x:2"]), ("x:2", None, "New title", ["arxiv:1", "x:2"]), ("x:2", None, "New title", []), ("x:3", None, None, None), (None, "10.1/z", "known TITLE!", [])]
    out = I.ingest(papers, spark.createDataFrame(rec, "external_id string, doi string, title string, references array<string>"), {"title": F.length("title") > 2}, lambda c: F.lower(c))
    assert {x["what"]: x["n"] for x in out["counts"].collect()} == {"records": 5, "rejected": 1, "inserted": 1, "merged": 2, "edges": 2}
    assert [x["id"] for x in out["new"].collect()] == [6] and {(x["source"], x["target"]) for x in out["edges"].collect()} == {(5, 6), (6, 5)}
    none = spark.createDataFrame([], "external_id string, doi string, title string, references array<string>")
    assert {x["n"] for x in I.ingest(papers, none, {"title": F.lit(True)}, lambda c: c)["counts"].collect()} == {0}


def test_totals_equal_the_join(spark, monkeypatch):
    """Hits and sums of every query without pairs of query and document, in small blocks and with full rows and short ones."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["for"] * 30
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=12))) for i in range(150)] + [(900, None)], "doc bigint, text string")
    q = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=4))) for i in range(30)] + [("none", "zzz"), ("blank", " ")], "query_id string, query string")
    want = {x["query_id"]: (x["n"], round(x["t"], 6)) for x in R.bm25(docs, q).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("t")).collect()}
    key = lambda: {x["query_id"]: (x["hits"], round(x["total"], 6)) for x in R.bm25_totals(docs, q).collect()}
    assert key() == want and len(want) == 30
    monkeypatch.setattr(R, "BLOCK_DOCS", 13)
    assert key() == want
    monkeypatch.setattr("quillspark.runtime.BROADCAST_BYTES", 10)
    assert key() == want


def test_many_topics_are_split(spark):
    """More than 80 topics, among them many of equal penalty; ties go to the first in order."""
    rows = [(f"t{i:03}", 5 if i % 3 else 4, 1, 1, int(i > 10)) for i in range(300)]
    s = S.balanced_splits(spark.createDataFrame(rows, "query_id string, negatives int, b0 int, b1 int, b2 int"), 1, 5)
    assert s["val"] == ["t011"] and s["test"] == ["t013"] and len(s["train"]) == 298


def test_rank_correlation_of_constant_groups(spark):
    rows = [("flat", 1.0, float(i)) for i in range(3)] + [("one", 1.0, 2.0)] + [("up", float(i), float(i * i)) for i in range(4)] + [("down", float(i), -float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    assert {x["g"]: round(x["rho"], 9) for x in E.rank_correlation(df, "g", "a", "b").collect()} == {"flat": 0.0, "one": 0.0, "up": 1.0, "down": -1.0}
    got = {(x["a"], x["b"]): x["r"] for x in E.correlations(df.where("g = 'flat'"), ["a", "b"]).collect()}
    assert got == {("a", "b"): 0.0}


def test_personal_scores_of_both_paths(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=6)), None) for i in range(120)] + [(500, None, None), (501, "lonely", "")], "doc bigint, title string, abstract string")
    prof = spark.createDataFrame([(u, rng.sample(range(120), 5) + [501] * (u == 2), rng.sample(range(120), u % 3) + [500, 999]) for u in range(7)] + [(9, [], [])], "user bigint, saved array<bigint>, skipped array<bigint>")
    key = lambda: sorted(tuple(round(v, 9) for v in x) for x in N.personal_scores(docs, prof).collect())
    fast = key()
    monkeypatch.setattr(N, "MEMBERS", 4)
    assert key() == fast and len(fast) > 300
    monkeypatch.setattr(N, "_by_blocks", None)  # only the index is left
    monkeypatch.setattr("quillspark.runtime.BROADCAST_BYTES", 10)
    assert key() == fast


def _best_sides(rows, size, target):
    """All choices of val and test, one after the other."""

    def penalty(side):
        n, buckets = sum(r[1] for r in side), [sum(r[i] for r in side) for i in (2, 3, 4)]
        return n, abs(n - target) + 100_000.0 * ((min(buckets) == 0) + (n == 0))

    found = []
    for val in itertools.combinations(sorted(rows), size):
        for test in itertools.combinations(sorted(set(rows) - set(val)), size):
            (n, p), (m, q) = penalty(val), penalty(test)
            found.append((p + q + 1.5 * abs(n - m), [r[0] for r in val], [r[0] for r in test]))
    return min(found)[1:] if found else ([], [])


def test_sides_of_several_topics(spark):
    """Sides of one to three topics are the best of all choices, with many topics alike and with few."""
    rng = random.Random(31)
    for size, topics, most in ((1, 12, 3), (2, 14, 2), (2, 14, 12), (2, 3, 4), (3, 9, 3)):
        rows = [(f"t{i:02}", rng.randint(0, most), rng.randint(0, 2), rng.randint(0, 1), rng.randint(0, 3)) for i in rng.sample(range(99), topics)]
        t = spark.createDataFrame(rows, "query_id string, negatives int, b0 int, b1 int, b2 int")
        assert S.balanced_sides(t, size, 5) == _best_sides(rows, size, 5)
    many = spark.createDataFrame([(f"t{i:04}", 2 + i % 3, 1, int(i % 7 == 0), 1) for i in range(2000)], "query_id string, negatives int, b0 int, b1 int, b2 int")
    assert S.balanced_sides(many, 2, 5) == (["t0000", "t0001"], ["t0003", "t0007"])


def test_balanced_topics_has_two_topics_a_side(spark, tmp_path):
    """The query and its SQL against all choices, on made tables with and without enough topics."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(32)
    for topics in (15, 3):
        d = tmp_path / str(topics)
        queries, sources = [f"q{i:02}" for i in range(topics)], ["manual", "co_citation", "title"]
        examples = [(rng.choice(queries), rng.randrange(40), rng.sample(range(40), rng.randint(1, 2)), rng.choice(sources)) for _ in range(3 * topics)]
        tables = {"training_examples": (examples, "query_id string, positive_paper_id bigint, negative_paper_ids array<bigint>, label_source string"), "manual_queries": ([(q,) for q in queries], "query_id string"), "papers": ([(i, i, 2000 + i, "a") for i in range(40)], "id bigint, citation_count bigint, year bigint, abstract string")}
        con = duckdb.connect()
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{d}/{name}.parquet/*.parquet')")
        got = sorted(tuple(x) for x in QS.balanced_topics(spark, str(d)).collect())
        counts = QS.labelled(spark, str(d)).groupBy("query_id").agg(F.sum(F.col("negative").cast("int")), *[F.sum((F.col("bucket") == b).cast("int")) for b in (0, 1, 2)])
        rows = [tuple(x) for x in counts.collect()]
        val, test = _best_sides(rows, 2, 5)
        assert len(val) == len(test) == (2 if topics > 3 else 0)
        assert got == sorted(("val" if r[0] in val else "test" if r[0] in test else "train", r[0]) for r in rows) == sorted(con.execute(QS.SQL["balanced_topics"]).fetchall())
