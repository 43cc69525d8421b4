import random

import numpy as np
import pytest

from quillspark.llm import vectors
from quillspark.llm.components import components
from quillspark.llm.grouped_splits import assign_splits, linked_rows, torn_groups
from quillspark.llm.vectors import Tree, nearest


def union_find(pairs, nodes):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (8, None), (None, 9)]
    df = spark.createDataFrame(pairs + pairs[:5], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(df, "a", "b").collect()}
    real = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    assert got == union_find(real, {x for p in real for x in p})
    assert components(df.limit(0), "a", "b").count() == 0


def test_linked_rows_and_splits(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(60)]), rng.choice([None, None, "q0", "q1", *["q%d" % k for k in range(40)]]), rng.choice(["train", "val", None])) for i in range(300)]
    rows += [(1000 + i, 500, None, "test") for i in range(150)]  # one entity holds a third of the rows
    df = spark.createDataFrame(rows + rows[:4], "example_id bigint, p int, q string, split string").withColumnRenamed("p", "row")
    groups = linked_rows(df, "example_id", "row", "q")
    pairs = []
    for k in (1, 2):
        first = {}
        for r in rows:
            if r[k] is not None:
                pairs.append((first.setdefault(r[k], r[0]), r[0]))
    want = union_find(pairs, [r[0] for r in rows])
    got = [(r["example_id"], r["group_id"]) for r in groups.collect()]
    assert dict(got) == want and len(got) == len(rows)
    kinds = {}
    for r in rows:
        kinds.setdefault(want[r[0]], set()).add(r[3])
    torn = {(r["example_id"], r["group_id"]) for r in torn_groups(groups, df.dropDuplicates(["example_id"]), "example_id", "split").collect()}
    assert torn == {(x, g) for x, g in want.items() if len(kinds[g] - {None}) > 1}
    parts = assign_splits(groups, "example_id", {"train": 0.8, "val": 0.1, "test": 0.1}).collect()
    assert len(parts) == len(rows)
    by = {}
    for r in parts:
        by.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    empty = linked_rows(df.limit(0), "example_id", "row", "q")
    assert empty.count() == 0 and assign_splits(empty, "example_id", {"train": 1.0}).count() == 0


def test_best_bin_first_visits_every_leaf_once():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = Tree(x, 16)
    order = tree.visits(x[:20], tree.leaves)
    assert all(sorted(r) == list(range(tree.leaves)) for r in order.tolist())
    assert (order[:, 0] == tree.assign(x[:20])).all()


def brute(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -9)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i], kind="stable")[:k]}


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr("quillspark.llm.vectors.LEAF_ROWS", 30)
    monkeypatch.setattr("quillspark.llm.vectors.BLOCK", 16)  # leaves and their queries are split
    monkeypatch.setattr("quillspark.llm.vectors.QUERY_BLOCK", 64)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(9, 6))
    vectors = {i: (centre[i % 9] + 0.3 * rng.normal(size=6)).astype(np.float32).tolist() for i in range(300)}
    same = rng.normal(size=6).astype(np.float32).tolist()
    vectors.update({1000 + i: same for i in range(150)})  # a group of copies holds a third of the rows
    rows = [(i, v) for i, v in vectors.items()] + [(1, vectors[1]), (2000, None), (2001, [0.0] * 6), (2002, [1.0] * 5), (2003, [float("nan")] * 6), (None, same)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "document_id bigint, embedding array<float>, vid string").repartition(4)
    got = [(r["id"], r["other"]) for r in nearest(df, "document_id", "embedding", 6, 10, recall=1.0).collect()]
    want = brute(vectors, 10)
    assert len(got) == len(set(got)) == 10 * len(vectors)
    assert len(set(got) & want) / len(want) >= 0.98
    assert {p for p in got if p[0] >= 1000} == {p for p in want if p[0] >= 1000}  # ties go to the smaller id


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_nearest_of_few(spark, n):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "id bigint, v array<float>")
    assert nearest(df, "id", "v", 2, 3).count() == n * min(3, max(0, n - 1))


def test_nearest_in_rounds(spark, monkeypatch):
    """The search in many rounds gives the same rows as in one, and leaves no shuffle of all its copies on disk."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(400)], "id bigint, v array<float>").repartition(4)
    monkeypatch.setattr("quillspark.llm.vectors.LEAF_ROWS", 10)
    key = lambda: sorted((r["id"], r["place"], r["other"]) for r in nearest(df, "id", "v", 8, 5).collect())
    whole = key()
    turns = []
    monkeypatch.setattr("quillspark.llm.vectors.ROUND_BYTES", 2_000)
    monkeypatch.setattr("quillspark.llm.vectors.BLOCK", 32)
    plain = vectors.materialize
    monkeypatch.setattr(vectors, "materialize", lambda d, tag: turns.append(tag) or plain(d, tag))
    assert key() == whole and len(whole) == 2000
    assert turns.count("vector-near") > 2
