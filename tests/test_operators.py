import datetime as dt
import difflib
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import signals as G
from quillspark.functions import text as T
from quillspark.operators import corpus as C
from quillspark.operators import evaluation as E
from quillspark.operators import fusion as X
from quillspark.operators import learning as L
from quillspark.operators import near_titles
from quillspark.operators import ranking as N
from quillspark.operators import readers as P
from quillspark.operators import retrieval as R
from quillspark.operators.integrity import normal_identifier, orphan_references
from quillspark.operators.joins import skew_join


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,want",
    [(" DOI: 10.5555/RP.1 ", "10.5555/rp.1"), ("https://doi.org/10.5/A", "10.5/a"), ("https://arxiv.org/abs/1234.56789v2", "arxiv:1234.56789"), ("arXiv:1234.56789V3", "arxiv:1234.56789"), ("https://openalex.org/W12", "openalex:w12"), ("  ", ""), (None, None)],
)
def test_identifier(spark, raw, want):
    assert one(spark, normal_identifier(F.lit(raw).cast("string"))) == want


def test_text_functions(spark):
    assert one(spark, T.lexical_tokens(F.lit("Größe A_1 b"))) == ["gr", "e", "a_1", "b"]
    assert one(spark, T.lexical_tokens(F.lit(None).cast("string"))) == []
    assert one(spark, T.normal_title(F.lit("  The--Big, Model! "))) == "the big model"
    assert one(spark, T.arxiv_id(F.lit("see https://arxiv.org/pdf/2101.00001v3"))) == "2101.00001"
    assert one(spark, T.normal_arxiv(F.lit("https://arxiv.org/pdf/2101.00001v3.pdf"))) == "2101.00001"
    assert one(spark, T.normal_openalex(F.lit("https://openalex.org/w12/"))) == "W12"
    assert one(spark, T.union_lists(F.array(F.lit("A"), F.lit(" b ")), F.array(F.lit("B"), F.lit("c"), F.lit("")))) == ["A", "b", "c"]
    assert one(spark, T.snippet(F.lit("ab  " * 200), 20)) == "ab ab ab ab ab ab..."
    assert one(spark, T.json_ints(F.lit("[3, 1, 3]"))) == [1, 3] and one(spark, T.json_ints(F.lit("oops"))) == []
    assert one(spark, T.clamp(F.lit(float("nan")))) is None or one(spark, T.clamp(F.lit(2.0))) == 1.0
    assert one(spark, T.parse_time(F.lit("2024-05-01"))) == dt.datetime(2024, 5, 1)


DOCS = [(1, "graph neural network survey", "graph neural network survey", "a graph overview", 2024, 1500), (2, "deep graph model", "deep graph model", "model of models", 2020, 5), (3, "unrelated", "unrelated", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, a, b, None, ["x"], y, c, 0, c, 0) for i, t, a, b, y, c in DOCS]
    return spark.createDataFrame(rows, "doc bigint, text string, title string, abstract string, venue string, categories array<string>, year int, citation_count int, references_count int, influential_citation_count int, abstract_word_count int")


def test_bm25_by_hand(spark, docs):
    q = spark.createDataFrame([("a", "graph Graph"), ("b", " "), ("c", "nothing")], "query_id string, query string")
    got = {(r["query_id"], r["doc"]): r["score"] for r in R.bm25(docs, q).collect()}
    idf, mean = math.log(1 + (3 - 2 + 0.5) / 2.5), 8 / 3
    want = lambda n: 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * n / mean))
    assert set(got) == {("a", 1), ("a", 2)} and got["a", 1] == pytest.approx(want(4), abs=1e-8) and got["a", 2] == pytest.approx(want(3), abs=1e-8)
    assert R.bm25(docs.limit(0), q).count() == 0


def test_hybrid_and_path(spark, docs):
    q = spark.createDataFrame([("a", "graph model")], "query_id string, query string")
    pool = R.hybrid(docs, q, 5, now=2024)
    assert {r["doc"] for r in pool.collect()} == {1, 2}
    path = P.reading_path(P.section_scores(pool), 1).collect()
    assert len({r["doc"] for r in path}) == len(path) and all(r["section_score"] >= G.SECTION_LEAST[r["section"]] for r in path)


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "doc bigint, embedding array<float>")
    q = v.where("doc = 1").withColumnRenamed("doc", "query_id")
    assert [(r["doc"], round(r["score"], 6)) for r in R.dense_search(v, q, 2).orderBy("doc").collect()] == [(2, 1.0), (3, 0.0)]
    assert R.dense_search(v, q.limit(0), 2).count() == 0


def test_scaling(spark):
    d = spark.createDataFrame([("q", 1, 2.0), ("q", 2, -1.0), ("c", 1, 3.0), ("c", 2, 3.0)], "g string, doc int, s double")
    get = lambda f: {(r["g"], r["doc"]): r["normal"] for r in f.collect()}
    assert get(N.max_normal(d, "g", "s")) == {("q", 1): 1.0, ("q", 2): 0.0, ("c", 1): 1.0, ("c", 2): 1.0}
    assert get(N.minmax_normal(d, "g", "s", 0.5, 1e-12))["c", 1] == 0.5 and get(N.minmax_normal(d, "g", "s"))["c", 1] == 0.0
    assert get(N.z_normal(d, "g", "s")) == {("q", 1): 1.0, ("q", 2): -1.0, ("c", 1): 0.0, ("c", 2): 0.0}


def test_swap_limit(spark):
    rows = [("q", i, 1.0 - i / 10, i / 10) for i in range(8)]
    d = spark.createDataFrame(rows, "query_id string, doc bigint, base double, other double")
    out = {r["doc"]: r for r in X.swap_limited(d, "query_id", "base", "other", k=3).collect()}
    assert [i for i in out if out[i]["entrant"]] and sum(r["entrant"] for r in out.values()) == 2
    assert all(abs(out[i]["score"] - (1.0 - i / 10)) <= 0.005 + 1e-9 for i in out if not out[i]["entrant"])


def test_metrics(spark):
    rows = [("m", "q", 1, 0.9, 1.0, False), ("m", "q", 2, 0.8, None, True), ("m", "q", 3, 0.7, 0.5, False), ("m", "z", 1, 0.1, None, None)]
    r = {x["query_id"]: x for x in E.per_query(spark.createDataFrame(rows, "method string, query_id string, doc int, score double, gain double, negative boolean"), 2).collect()}
    assert r["q"]["recall"] == 0.5 and r["q"]["precision"] == 0.5 and r["q"]["mrr"] == 1.0 and r["q"]["negative_share"] == 0.5 and r["q"]["judged"] == 1
    assert r["q"]["ndcg_linear"] == pytest.approx(1 / (1 + 0.5 / math.log2(3))) and r["z"]["ndcg_linear"] == 0.0


def test_orphans(spark):
    p = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 20)) for i in range(200)] + [(500, None)], "key bigint, born timestamp")
    refs = [(i, i * 7 % 300, dt.datetime(2024, 1, 10)) for i in range(300)] + [(900, None, None), (901, 500, dt.datetime(2000, 1, 1)), (902, 5, None)]
    r = spark.createDataFrame([(*x, "clash", 1) for x in refs], "id bigint, ref bigint, at timestamp, reason string, key int")
    born = {row["key"]: row["born"] for row in p.collect()}
    want = {(i, "missing" if ref not in born else "later") for i, ref, at in refs if ref is not None and (ref not in born or (born[ref] and at and born[ref] > at))}
    assert {(x["id"], x["reason"]) for x in orphan_references(r, p, since="born", until="at").collect()} == want
    assert orphan_references(r.limit(0), p).count() == 0 and orphan_references(r, p.limit(0)).count() == len(refs) - 1


def test_orphans_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr("quillspark.runtime.BROADCAST_BYTES", 10)
    p = spark.createDataFrame([(i,) for i in range(50)], "key bigint")
    r = spark.createDataFrame([(i, i) for i in range(80)], "id bigint, ref bigint")
    assert {x["id"] for x in orphan_references(r, p).collect()} == set(range(50, 80))


def test_skew_join(spark):
    left = spark.range(300_000).select(F.when(F.col("id") < 200_000, 1).otherwise(F.col("id")).cast("long").alias("k"), "id")
    right = spark.createDataFrame([(1, "hot"), (250_000, "cold")], "k bigint, v string")
    assert {r["v"]: r["count"] for r in skew_join(left, right, "k", "inner").groupBy("v").count().collect()} == {"hot": 200_000, "cold": 1}


def test_folding_depends_on_order(spark):
    rows = [(1, "a", None, "t one"), (2, "b", None, "t two"), (3, "a", None, "t two"), (4, None, None, "t two"), (5, None, None, None)]
    got = {r["id"]: r["kept"] for r in C.fold_duplicates(spark.createDataFrame(rows, "id bigint, external_id string, doi string, title string"), "id").collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5}


def test_folding_of_many_blocks_together(spark, monkeypatch):
    monkeypatch.setattr(C, "FOLDED", 4)
    rows = [(i, f"x{i % 20}" if i % 3 else None, f"10.5/{i % 33}" if i % 5 == 0 else None, f"title {i % 40}" if i % 2 else None) for i in range(120)]
    owner, want = {}, {}
    for i, x, doi, title in rows:
        keys = [k for k in (x and ("x", x), doi and ("d", doi), title and ("t", title)) if k]
        want[i] = next((owner[k] for k in keys if k in owner), i)
        owner.update(dict.fromkeys(keys, want[i]))
    got = C.fold_duplicates(spark.createDataFrame(rows, "id bigint, external_id string, doi string, title string"), "id")
    assert {r["id"]: r["kept"] for r in got.collect()} == want


NEAR = ["decoding masked reader with quamacast", "p decoding masked reader with quamacast p", "online buffer and regularised verifier in wildoife acoustics", "online bu er and regularised veri er in wildlife acoustics"]


def test_near_titles_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 10))) for _ in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 16))) for _ in range(40)]
    titles = set(NEAR) | set(base)
    for s in base * 4:
        for _ in range(rng.randrange(1, 6)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abc ") + s[i:], s[:i] + "z" + s[i + 1 :]])
        titles |= {" ".join(s.split()), " ".join(rng.sample(s.split(), len(s.split())))}
    titles = sorted(titles)

    def similar(a, b):
        p, q = set(a.split()), set(b.split())
        return max(difflib.SequenceMatcher(None, a, b).ratio(), len(p & q) / len(p | q))

    long = [(i, t) for i, t in enumerate(titles) if len(t) >= 20]
    want = {(i, j) for i, a in long for j, b in long if i < j and similar(a, b) >= 0.92}
    rows = C.near_titles(spark.createDataFrame(list(enumerate(titles)), "id bigint, title string"), "id", "title").collect()
    at = {t: i for i, t in enumerate(titles)}
    assert {(r["row_a"], r["row_b"]) for r in rows} == want and len(rows) == len(want)
    assert {tuple(sorted((at[NEAR[0]], at[NEAR[1]]))), tuple(sorted((at[NEAR[2]], at[NEAR[3]])))} <= want


@pytest.mark.parametrize("least", [0.9, 0.92])
def test_near_titles_in_groups_equal_brute_force(spark, monkeypatch, least):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 10))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([4, 7, 12, 13, 26]))) for _ in range(16)]
    titles = set(base)
    for s in base * 3:
        swap = s.split()
        swap[rng.randrange(len(swap))] = rng.choice(words)
        for _ in range(rng.randrange(1, 7)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abc ") + s[i:], s[:i] + s[i + 1 : i + 2] + s[i : i + 1] + s[i + 2 :]])
        titles |= {" ".join(s.split()), " ".join(swap), " ".join(rng.sample(swap, len(swap)))}
    titles = sorted(t for t in titles if len(t) >= 20)

    def similar(a, b):
        p, q = set(a.split()), set(b.split())
        return max(difflib.SequenceMatcher(None, a, b).ratio(), len(p & q) / len(p | q))

    want = {(a, b): (similar(a, b), similar(b, a)) for i, a in enumerate(titles) for b in titles[i + 1 :]}
    want = {k: v for k, v in want.items() if max(v) >= least}
    monkeypatch.setattr(near_titles, "BROADCAST_BYTES", 20_000)  # several groups
    monkeypatch.setattr(near_titles, "small_enough", lambda rows, row_bytes: False)
    monkeypatch.setattr(near_titles, "COLUMNS", 50)
    rows = near_titles.near_title_links(spark.createDataFrame([(t,) for t in titles], "t string"), least).collect()
    assert {(r["a"], r["b"]): (r["ab"], r["ba"]) for r in rows} == want and len(rows) == len(want)


def test_titles_whose_letters_are_far_apart_are_not_compared(monkeypatch):
    rng = random.Random(3)
    titles = ["".join(rng.choice(letters) for _ in range(60)) for letters in ("eituab", "rnlmcd", "oascgh") for _ in range(500)]
    titles.append(titles[7][:30] + "q" + titles[7][31:])
    held = near_titles.Titles(pa.array(titles))
    tests = held.tests()
    met, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x, **k: (met.append(x.size if x.ndim > 1 else 0), count(x, **k))[1])
    assert list(near_titles.candidates(held, held, tests, held.signs(tests), 0.92)) == [tuple(sorted((titles[7], titles[-1])))]
    assert sum(met) < 0.5 * len(titles) ** 2


@pytest.mark.parametrize("groups", [1, 2])
def test_near_titles_of_two_tables_equal_brute_force(spark, monkeypatch, groups):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 10))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([5, 7, 12, 24]))) for _ in range(20)]
    sides = [set(base[:12]), set(base[8:])]
    for s in base * 4:
        for _ in range(rng.randrange(1, 6)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abc ") + s[i:]])
        sides[rng.randrange(2)] |= {" ".join(s.split()), " ".join(rng.sample(s.split(), len(s.split())))}
    left, right = (sorted(t for t in x if len(t) >= 20) for x in sides)

    def similar(a, b):
        p, q = set(a.split()), set(b.split())
        return max(difflib.SequenceMatcher(None, a, b).ratio(), len(p & q) / len(p | q))

    want = {(a, b): (similar(a, b), similar(b, a)) for x in left for y in right if x != y for a, b in [sorted((x, y))]}
    want = {k: v for k, v in want.items() if max(v) >= 0.9}
    if groups > 1:
        monkeypatch.setattr(near_titles, "BROADCAST_BYTES", 20_000)
        monkeypatch.setattr(near_titles, "small_enough", lambda rows, row_bytes: False)
    titles = [spark.createDataFrame([(t,) for t in x], "t string") for x in (left, right)]
    rows = near_titles.near_title_links(titles[0], 0.9, titles[1]).collect()
    assert {(r["a"], r["b"]): (r["ab"], r["ba"]) for r in rows} == want and len(rows) == len(want) > 20


def test_titles_that_share_part_of_their_words_are_not_all_paired(spark):
    rng = random.Random(5)
    words = [f"w{i:02d}" for i in range(16)]
    titles = {" ".join(rng.sample(words, rng.choice([9, 10]))) for _ in range(300)}
    titles |= {" ".join([*t.split(), "more"]) for t in sorted(titles)[:20] if len(t.split()) == 9}
    titles = sorted(titles)
    got = near_titles._by_words(spark.createDataFrame([(t,) for t in titles], "t string"), 0.9).collect()
    sets = {t: set(t.split()) for t in titles}
    assert {tuple(r) for r in got} == {(a, b) for a in titles for b in titles if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]) - 1e-9}


def test_titles_that_share_their_rarest_word_are_not_all_paired(spark):
    # each title has a word that all have and nothing rarer: the words of a pair, not one word, must bring it up
    words = [f"w{i:02d}" for i in range(12)]
    titles = [" ".join(["rare", *c]) + " " for c in itertools.combinations(words, 5)]
    titles = [t.strip() for t in titles] + ["w00 w01 w02 w03 w04 rare"]
    got = near_titles._by_words(spark.createDataFrame([(t,) for t in titles], "t string"), 0.92).collect()
    assert [tuple(r) for r in got] == [("rare w00 w01 w02 w03 w04", "w00 w01 w02 w03 w04 rare")]


def test_near_titles_are_folded_and_penalised(spark):
    rows = [(1, "a", None, NEAR[0]), (2, "b", None, NEAR[1]), (3, "b", None, "something else entirely"), (4, None, None, NEAR[2]), (5, None, None, NEAR[3])]
    rows += [(100 + i, f"k{i}", f"10.5/{i + 1}", None) for i in range(3)]
    d = spark.createDataFrame(rows, "id bigint, external_id string, doi string, title string")
    assert {r["id"]: r["kept"] for r in C.fold_duplicates(d, "id").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 100: 100, 101: 101, 102: 102}
    c = d.selectExpr("'q' AS query_id", "id AS doc", "external_id", "doi", "title", "CASE WHEN id = 5 THEN 1.0D ELSE 0.0D END AS score", "2020 AS year", "0 AS citation_count")
    assert {r["doc"]: r["duplicate"] for r in P.duplicate_penalties(c).collect() if r["duplicate"]} == {2: 0.35, 3: 0.75, 4: 0.35}


def test_references_and_edges(spark):
    d = spark.createDataFrame([("A", ["b", " B", "a", "z", "", None]), ("b", None)], "k string, r array<string>")
    got = {(r["reference"], r["kind"]) for r in C.resolve_references(d, F.col("k"), F.col("r"), normal_identifier).collect()}
    assert got == {("b", "edge"), (" B", "repeated"), ("a", "self"), ("z", "missing")}


def test_batches_and_quotas(spark):
    d = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 6, 30, 1, 9])], "g string, i bigint, s int")
    assert [r["batch"] for r in C.size_batches(d, "g", "i", "s", 12).orderBy("i").collect()] == [0, 0, 1, 2, 2]
    q = spark.createDataFrame([("g", i, float(i), ["r"] if i < 3 else []) for i in range(10)], "g string, row bigint, score double, reasons array<string>")
    assert [r["row"] for r in C.quota_selection(q, "g", {"r": 2}, 4).orderBy("place").collect()] == [2, 1, 9, 8]


def test_pair_accuracy_counts_pairs(spark):
    rows = [("m", "q", i, float(i % 4), 1.0 if i % 3 == 0 else None, i % 3 == 1) for i in range(12)]
    good, bad = [r for r in rows if r[4]], [r for r in rows if r[5]]
    r = E.pair_accuracy(spark.createDataFrame(rows, "method string, query_id string, doc int, score double, gain double, negative boolean")).first()
    assert (r["pairs"], r["right"]) == (len(good) * len(bad), sum(a[3] > b[3] for a in good for b in bad))


def test_ridge(spark):
    rows = [(float(i), float(i % 5), 2.0 * i - 3.0 * (i % 5) + 7) for i in range(40)]
    m = L.ridge(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y", 1e-9)
    assert m["coefficients"]["a"] == pytest.approx(2, abs=1e-5) and m["coefficients"]["b"] == pytest.approx(-3, abs=1e-5) and m["intercept"] == pytest.approx(7, abs=1e-4)


def test_profile(spark):
    e = [(1, 5, "save", "beginner", dt.datetime(2024, 1, 1), ["A "]), (1, 6, "not_relevant", None, dt.datetime(2024, 1, 3), None), (1, 5, "too_hard", "advanced", dt.datetime(2024, 1, 2), []), (2, 1, "odd", None, None, None)]
    d = spark.createDataFrame(e, "user int, item bigint, action string, level string, ts timestamp, tags array<string>")
    r = {x["user"]: x for x in P.profile_fold(d).collect()}
    assert r[1]["saved"] == [5] and r[1]["skipped"] == [6] and r[1]["level"] == "advanced" and r[2]["events"] == 1
    assert P.library(d, "a").count() == 1 and P.library(d, "b").count() == 0
