import random

import numpy as np
import pandas as pd
import pytest

from quillspark.llm.matching import Scorer, _assign, assign_one_to_one, match_records
from quillspark.llm.metric_join import distances, encode, radius_pairs
from quillspark.llm.names import entity_classes, parse, variant_pairs


def damerau(a, b):
    last, top = {}, len(a) + len(b) + 1
    d = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            k, l = last.get(b[j - 1], 0), col
            if a[i - 1] == b[j - 1]:
                col = j
            d[i + 1][j + 1] = min(d[i][j] + (a[i - 1] != b[j - 1]), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][l] + (i - k - 1) + 1 + (j - l - 1))
        last[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 10))) for _ in range(60)]
    out = set(base)
    for s in base:
        for _ in range(3):
            i = rng.randrange(len(s))
            out.add(rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abcz") + s[i:], s[: i - 1] + s[i : i + 1] + s[i - 1 : i] + s[i + 1 :] if i else s]))
    return sorted(x for x in out if x)


def test_metric(strings):
    codes, size = encode(strings)
    for s in strings[::9]:
        assert distances(s, codes, size).tolist() == [damerau(s, t) for t in strings]


@pytest.mark.parametrize("radius,block", [(1, 1024), (2, 16)])
def test_radius_join_is_exact(spark, strings, radius, block, monkeypatch):
    monkeypatch.setattr("quillspark.llm.metric_join.BLOCK", block)
    df = spark.createDataFrame([(s, 1) for s in [*strings, strings[0], None, ""]], "s string, cell int").repartition(3)
    rows = radius_pairs(df, "s", radius).collect()
    got = {(r["a"], r["b"]): r["distance"] for r in rows}
    want = {(a, b): damerau(a, b) for i, a in enumerate(strings) for b in strings[i + 1 :] if damerau(a, b) <= radius}
    assert got == want and len(rows) == len(got)
    assert radius_pairs(df.limit(0), "s").count() == 0


def test_parse():
    assert parse("Kïngoghi, R.")[1:4] == ("kingoghi", "", "r")
    assert parse("Dr. Uschi van der Dussodahl†")[1:3] == ("vanderdussodahl", "ursula")
    assert parse("HL LÓRKOMARSH")[1:5] == ("lorkomarsh", "", "h", "l")
    assert parse("Consortium (Climate) Mernedez")[:3] == parse("Mernedez Climate Consortium")[:3] == ("consortium", "mernedez", "climate")
    assert parse("†*")[1] == "" and parse("x" * 5000)[1]


def test_variants(spark):
    people = [["Rosalind Kingoghi", " Kïngoghi, R. "], ["ROSLIND KINGOGHI", "Kingoghi Rosalind"], ["Fabian Kingoghi", "Fabian C. Kingoghi", None, "", "  "], None, [], ["Rosalind Kingoghi"]]
    people += [["Rosalind Tolmeholt"], ["Fabian Tolmeholt", "Rosalind Polmeski", "Fabian Polmeski", "Rosalind Zuppohara", "Fabian Zuppohara"]]
    people += [["Bacherup Climate Consortium", "The Bacherup Climate Consortium", "BACHERUP RETRIEVAL CONSORTIUM"]]
    df = spark.createDataFrame([(p, "x") for p in people], "authors array<string>, name string")
    rows = variant_pairs(df, "authors").collect()
    got = {(r["name_a"], r["name_b"]) for r in rows}
    one = ["Rosalind Kingoghi", "Kïngoghi, R.", "ROSLIND KINGOGHI", "Kingoghi Rosalind"]
    want = {(a, b) for a in one for b in one if a < b} | {("Fabian C. Kingoghi", "Fabian Kingoghi"), ("Bacherup Climate Consortium", "The Bacherup Climate Consortium")}
    assert got == want and len(rows) == len(got)
    assert entity_classes(df, "authors").where("name = 'ROSLIND KINGOGHI'").first()["spellings"] == 4
    assert variant_pairs(df.limit(0), "authors").count() == 0


PAPERS = [
    (1, "Dense Retrieval with Gamurank", "Ulrich Mengoridge; Xenia Koppaworth", 2020, "10.5/a"),
    (2, "Sparse Ranking for Storm Tracking", "Nikolai Hundesen", 2018, None),
    (3, "Orvaron: Selective Likelihood for Legal Retrieval", "Philippa Brüppaforth", None, None),
    (4, None, None, None, None),
    (5, "Dense Retrieval with Gamurank", "Ulrich Mengoridge; Xenia Koppaworth", 2020, None),
]
RECORDS = [
    (11, "dense retreival with gamurank (preprint)", "U. Mengoridge and X. Koppaworth", 2021, None),
    (12, "Selective Likelihood for Legal Retrieval", "P. Brüppaforth", 2001, "10.5/zz"),
    (13, "Sparse Ranking for Storm Tracking", "Nikolai Hundesen", 2009, None),
    (14, "Something Else Entirely in Vision", "Ulrich Mengoridge; Xenia Koppaworth", 2020, "10.5/a"),
    (15, None, None, None, None),
    (16, "", "Anonymous", 2020, None),
    (11, "dense retreival with gamurank (preprint)", "U. Mengoridge and X. Koppaworth", 2021, None),
]


def test_matching(spark, monkeypatch):
    schema = "id bigint, title string, authors string, year int, doi string"
    p, r = spark.createDataFrame(PAPERS, schema), spark.createDataFrame(RECORDS, schema).selectExpr("*", "1 AS src", "2 AS place")
    out = match_records(p, r)
    got = {(x["paper_id"], x["record_id"]): x["confidence"] for x in out.collect()}
    assert set(got) == {(1, 11), (5, 11), (3, 12)} and all(0 < c <= 1 for c in got.values())
    best = {(x["paper_id"], x["record_id"]) for x in assign_one_to_one(out).collect()}
    assert len(best) == 2 and (3, 12) in best
    assert match_records(p.limit(0), r).count() == 0 and match_records(p, r.limit(0)).count() == 0
    monkeypatch.setattr("quillspark.llm.matching.RUN_ROWS", 5)  # many runs: neighbours across their ends are still met
    assert {(x["paper_id"], x["record_id"]) for x in match_records(p, r).collect()} == set(got)


@pytest.mark.parametrize("stored,harvested", [(1, 30), (50, 5), (30, 30)])
def test_matching_of_many_copies(spark, stored, harvested):
    schema = "id bigint, title string, authors string, year int, doi string"
    p = spark.createDataFrame([(i, *PAPERS[0][1:]) for i in range(stored)], schema)
    r = spark.createDataFrame([(i, *PAPERS[0][1:]) for i in range(100, 100 + harvested)], schema)
    rows = match_records(p, r).collect()
    assert len(rows) == stored * harvested and {(x["paper_id"], x["record_id"]) for x in rows} == {(i, j) for i in range(stored) for j in range(100, 100 + harvested)}


@pytest.mark.parametrize("run_rows", [20_000, 7])
def test_matching_of_many_unequal_rows_with_one_key(spark, monkeypatch, run_rows):
    monkeypatch.setattr("quillspark.llm.matching.RUN_ROWS", run_rows)
    monkeypatch.setattr("quillspark.llm.matching.BLOCK_ROWS", 4)  # several blocks of one key
    schema = "id bigint, title string, authors string, year int, doi string"
    p = spark.createDataFrame([(i, *PAPERS[0][1:4], f"10.5/p{i}") for i in range(40)], schema)
    r = spark.createDataFrame([(i, *PAPERS[0][1:4], f"10.5/r{i}") for i in range(100, 130)], schema)
    assert match_records(p, r).count() == 40 * 30
    # a fault in the last word leaves the key of people and first words equal
    near = spark.createDataFrame([(200, "Dense Retrieval with Gamuranc", "Ulrich Mengoridge; Xenia Koppaworth", 2020, None)], schema)
    assert match_records(p, near).count() == 40


def test_assignment_is_optimal():
    rng = random.Random(6)
    for _ in range(40):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        pairs = [(i, 10 + j, rng.random()) for i in range(n) for j in range(m) if rng.random() < 0.7] or [(0, 10, 0.5)]
        got = _assign(pd.DataFrame(pairs, columns=["paper_id", "record_id", "confidence"]))
        assert got["paper_id"].is_unique and got["record_id"].is_unique

        def best(rest, used):
            if not rest:
                return 0.0
            (p, r, c), *more = rest
            skip = best(more, used)
            return max(skip, c + best(more, used | {p, r})) if p not in used and r not in used else skip

        assert got["confidence"].sum() == pytest.approx(best(pairs, frozenset()))


def test_large_components_are_assigned_to_the_end(spark, monkeypatch):
    monkeypatch.setattr("quillspark.llm.matching.EXACT_PAIRS", 10)
    pairs = spark.createDataFrame([(i, 1000 + j, 0.9) for i in range(40) for j in range(40)], "paper_id bigint, record_id bigint, confidence double")
    rows = assign_one_to_one(pairs).collect()
    assert len(rows) == len({r["paper_id"] for r in rows}) == len({r["record_id"] for r in rows}) == 40


def test_confidence_uses_years():
    s = Scorer(np.ones(1 << 17, np.int64), 10)
    a = (["dense", "retrieval", "gamurank"], frozenset({"mengoridge"}), 2020, None)
    assert s.confidence(a, a) > 0.9 and s.confidence(a, (a[0], a[1], 2015, None)) == 0.0


def test_family_names_one_edit_apart_stay_apart(spark):
    given = ["Hilda", "Lorenz", "Edgar", "Fabian", "Julius", "Carina", "Darius"]
    people = [f"{g} {f}" for f in ("Brandholt", "Brondholt", "Brundholt") for g in given]
    people += ["Walburga Brandholt", "W. Brandholt", "Wendel Brondholt", "W. Brondholt", "Wendel Brundholt"]
    # faults of faults: the last spelling is three edits from the name that it means
    people += ["Hilda Brondhollt"] * 3 + ["Hilda Brondholllt"] * 2 + ["Hilda Brondhollltt"]
    df = spark.createDataFrame([(people,)], "authors array<string>")
    got = {(r["name_a"], r["name_b"]) for r in variant_pairs(df, "authors").collect()}
    faults = sorted(["Hilda Brondhollltt", "Hilda Brondholllt", "Hilda Brondhollt", "Hilda Brondholt"])
    want = {("W. Brandholt", "Walburga Brandholt"), ("W. Brondholt", "Wendel Brondholt")} | {(a, b) for i, a in enumerate(faults) for b in faults[i + 1 :]}
    assert got == want
