"""Paths that only large or skewed tables take, forced here by small bounds: the results must not change."""

import itertools
import random

import pandas as pd
import pytest

from quillspark.llm import components as K
from quillspark.llm import contamination as C
from quillspark.llm import matching as M
from quillspark.llm import overlap as O
from quillspark.llm.metric_join import radius_pairs
from quillspark.llm.names import entity_classes, variant_pairs
from quillspark.operators import joins as J


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(K, "HOT_ROWS", 5), monkeypatch.setattr(J, "HOT_ROWS", 5)
    monkeypatch.setattr(J, "HOT_SHARE", 0.05)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in K.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(60), 0), **dict.fromkeys(range(100, 141), 100)}


def test_contamination_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(words, k=20))) for i in range(25)]
    docs = [(i, " ".join(rng.choices(words, k=15)) + " " + (items[i % 25][1] if i % 2 else "")) for i in range(60)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items + [(77, items[0][1])], "item_id bigint, text string")
    key = lambda df: sorted((r["doc_id"], r["item_id"], r["shared"], r["longest_run"], round(r["best_window"], 6)) for r in df.collect())
    whole = key(C.contaminated(d, i))
    monkeypatch.setattr(C, "BROADCAST_BYTES", 2_000)
    assert key(C.contaminated(d, i)) == whole and {(r[0], r[1]) for r in whole} >= {(1, 1), (25, 0), (25, 77)}


def test_overlaps_with_hot_cells(spark, monkeypatch):
    rng = random.Random(5)
    base = "one two three four five six seven eight".split()
    rows = [(i, rng.choice(["train", "test"]), 1, " ".join(base + rng.choices("abcdefgh", k=3)), "s") for i in range(80)]
    df = spark.createDataFrame(rows, "id bigint, split string, key bigint, text string, source string")
    key = lambda: sorted((r["train_id"], r["eval_id"]) for r in O.cross_split_overlaps(df, "id", "split", "key", "text").collect())
    whole = key()
    monkeypatch.setattr(O, "CELL_ROWS", 6)
    assert key() == whole and len(whole) > 100


def test_matching_in_short_runs(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"topic{i}" for i in range(60)]
    papers = [(i, " ".join(rng.choices(words, k=6)), f"Anna Family{i % 9}", 2000 + i % 5, None) for i in range(60)]
    records = [(1000 + i, papers[i % 60][1] + (" extra" if i % 3 == 0 else ""), papers[i % 60][2], papers[i % 60][3], None) for i in range(90)]
    schema = "id bigint, title string, authors string, year int, doi string"
    p, r = spark.createDataFrame(papers, schema), spark.createDataFrame(records, schema)
    key = lambda: {(x["paper_id"], x["record_id"]) for x in M.match_records(p, r).collect()}
    whole = key()
    monkeypatch.setattr(M, "RUN_ROWS", 40)
    assert key() == whole and {(i % 60, 1000 + i) for i in range(90)} <= whole


@pytest.mark.parametrize("seed", range(3))
def test_assignment_is_optimal(seed):
    rng = random.Random(seed)
    for _ in range(60):
        pairs = [(p, 10 + r, rng.choice([0.5, 0.9, 0.9, 0.7])) for p in range(rng.randint(1, 4)) for r in range(rng.randint(1, 4)) if rng.random() < 0.7]
        if not pairs:
            continue
        out = M._assign(pd.DataFrame(pairs, columns=["paper_id", "record_id", "confidence"]))
        best = max(sum(c for _, _, c in s) for n in range(1, 5) for s in itertools.combinations(pairs, n) if len({p for p, _, _ in s}) == n == len({r for _, r, _ in s}))
        assert out["confidence"].sum() == pytest.approx(best) and out["paper_id"].is_unique and out["record_id"].is_unique


def test_radius_join_in_parts(spark, monkeypatch):
    rng = random.Random(7)
    strings = sorted({"".join(rng.choices("abc", k=rng.randint(3, 6))) for _ in range(120)})
    df = spark.createDataFrame([(x,) for x in strings], "s string")
    whole = {(r["a"], r["b"]) for r in radius_pairs(df, "s", 1).collect()}
    monkeypatch.setattr("quillspark.llm.metric_join.BLOCK", 7)
    monkeypatch.setattr("quillspark.llm.metric_join.PIVOTS_ROWS", 10)
    assert {(r["a"], r["b"]) for r in radius_pairs(df, "s", 1).collect()} == whole and whole


def test_name_classes_agree_with_pairs(spark):
    df = spark.createDataFrame([(["Maria Schneider", "M. Schneider", "Schneider, Maria", None, " "],), (["Maria Schnieder", "Maria Schneider", "Otto Keller"],)], "authors array<string>")
    rows = {r["name"]: r for r in entity_classes(df, "authors").collect()}
    linked = {x for r in variant_pairs(df, "authors").collect() for x in r}
    assert {n for n, r in rows.items() if r["spellings"] > 1} == linked and rows["Otto Keller"]["spellings"] == 1
    assert entity_classes(df.limit(0), "authors").count() == 0


def test_large_components_are_assigned_exactly(spark, monkeypatch):
    """A chain in which the best pair of its surroundings is wrong: the total must not depend on the component's size."""
    chain = [(i // 2, 1000 + (i + 1) // 2, 0.9 if i % 3 == 1 else 0.8) for i in range(60)]
    pairs = spark.createDataFrame(chain, "paper_id bigint, record_id bigint, confidence double")
    total = lambda: round(sum(r["confidence"] for r in M.assign_one_to_one(pairs).collect()), 6)
    whole = total()
    monkeypatch.setattr(M, "EXACT_PAIRS", 10)
    assert total() == whole == round(M._assign(pd.DataFrame(chain, columns=["paper_id", "record_id", "confidence"]))["confidence"].sum(), 6)
