import random
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pytest

from quillspark.llm.contamination import contaminated
from quillspark.llm.gray_index import GrayIndex, fingerprints, gray_rank
from quillspark.llm.near_duplicates import near_duplicate_classes, near_duplicate_pairs
from quillspark.llm.overlap import cross_split_overlaps, overlap_report
from quillspark.llm.shingles import distinct_shingles, words


@lru_cache(maxsize=None)
def grams(text, n=3):
    w = re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def jaccard(a, b, n=3):
    x, y = grams(a, n), grams(b, n)
    return len(x & y) / len(x | y) if x | y else 0.0


def noisy(rng, base, k):
    w = base.split()
    for _ in range(k):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], ["zz%d" % rng.randrange(99)], [w[i], "yy"]])
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(60)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(25)]
    out = [noisy(rng, rng.choice(base), rng.randrange(0, 9)) for _ in range(160)]
    return out + [out[0], out[0], "", None, "ÄÖ ﬁx ２", "a b", "long " * 30_000]


def test_words_follow_nfkc():
    assert words("Ｆｏｏ-ﬁx_2½ é") == ["foo", "fix", "21", "2", "é"] and words(None) == []


def test_gray_neighbours_differ_in_one_bit():
    codes = np.array([[i ^ (i >> 1), 0, 0, 0] for i in range(64)], np.uint64) << np.uint64(58)
    assert (gray_rank(codes)[:, 0] >> np.uint64(58)).tolist() == list(range(64))


def test_gray_index_equals_scan(texts):
    kept = [t for t in texts if t and len(t) < 10_000]
    s, d = distinct_shingles(kept, 3)
    fp, size = fingerprints(s, d, len(kept)), np.bincount(d, minlength=len(kept))
    q, r = GrayIndex(fp, size).within(fp, size, 1 / 3)
    off = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(off <= (size[:, None] + size[None]) / 3 + 1e-9))}
    assert set(zip(q.tolist(), r.tolist())) == want


@pytest.mark.parametrize("n,t", [(3, 0.5), (5, 0.8)])
@pytest.mark.parametrize("block", [2048, 8])
def test_pairs_equal_brute_force(spark, texts, n, t, block, monkeypatch):
    monkeypatch.setattr("quillspark.llm.gray_index.BLOCK", block)  # small blocks: hot cells are split
    df = spark.createDataFrame([(i, x, i, "c") for i, x in enumerate(texts)], "id bigint, text string, rep int, cell string").repartition(5)
    rows = near_duplicate_pairs(df, "id", "text", n, t).collect()
    got = {(r["id_a"], r["id_b"]) for r in rows}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j], n) >= t}
    assert got == want and len(rows) == len(got)


def test_classes_and_empty_table(spark, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id bigint, text string")
    rows = {r["id"]: r for r in near_duplicate_classes(df, "id", "text", 3, 0.5).collect()}
    assert len(rows) == len(texts) and rows[0]["class_id"] == rows[160]["class_id"] and rows[0]["links"] == rows[161]["links"]
    assert near_duplicate_classes(df.limit(0), "id", "text").count() == 0
    assert near_duplicate_pairs(df.limit(0), "id", "text").count() == 0


def test_cross_split_overlaps(spark, texts):
    rng = random.Random(3)
    splits = ["train", " Training", "VAL", "dev", "test ", None, "other"]
    rows = [(i, rng.choice(splits), rng.choice([1, 1, 1, 2, None]), t, "s", True) for i, t in enumerate(texts)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "example_id bigint, split string, positive_paper_id bigint, query_text string, label_source string, train boolean")
    out = cross_split_overlaps(df, "example_id", "split", "positive_paper_id", "query_text")
    got = [(r["train_id"], r["eval_id"]) for r in out.collect()]
    side = {"train": 0, " Training": 0, "VAL": 1, "dev": 1, "test ": 1}
    want = {(a[0], b[0]) for a in rows for b in rows if side.get(a[1]) == 0 and side.get(b[1]) == 1 and a[2] is not None and a[2] == b[2] and ((a[3] or "") == (b[3] or "") or jaccard(a[3], b[3]) >= 0.5)}
    assert set(got) == want and len(got) == len(want) and want
    assert overlap_report(df, "example_id", "split", "label_source", "positive_paper_id", "query_text").agg({"pairs": "sum"}).first()[0] == len(want)
    assert cross_split_overlaps(df.limit(0), "example_id", "split", "positive_paper_id", "query_text").count() == 0


def test_contamination(spark):
    rng = random.Random(9)
    vocabulary = ["v%d" % i for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 14, 40])))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for k in range(120):
        w = [rng.choice(vocabulary) for _ in range(60)]
        it = rng.choice(items[:30])[1].split()
        cut = it[: max(1, int(len(it) * rng.random() * 1.2))]
        w[20:20] = cut if rng.random() < 0.7 else []
        docs.append((k, " ".join(w), k))
    docs += [(200, None, 1), (201, "", 1), (202, "of the " * 20_000, 1), docs[0]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, gram int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    rows = contaminated(d, i).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    run = lambda t: grams(t, 12)
    want = set()
    for k, t, _ in docs:
        for j, u in items:
            a = grams(u)
            if t and u and ((a and len(a & grams(t)) >= 0.6 * len(a) - 1e-9) or run(u) & run(t)):
                want.add((k, j))
    assert got == want and len(rows) == len(got) and want
    assert contaminated(d.limit(0), i).count() == 0 and contaminated(d, i.limit(0)).count() == 0
