"""SQL of the training-data queries that SQL can express, for comparison on small tables: it compares all with all.

SQL has no Unicode NFKC, so the compatibility characters that matter for words are written out: digits of full width,
raised digits and ligatures.
"""

from __future__ import annotations

from quillspark.llm.overlap import SPLIT_NAMES

_SPLIT = "CASE lower(trim(split)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPLIT_NAMES.items()) + " END"


def _words(text: str) -> str:
    plain = f"translate({text}, '０１２３４５６７８９¹²³', '0123456789123')"
    for sign, letters in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        plain = f"replace({plain}, '{sign}', '{letters}')"
    return f"regexp_extract_all(lower(nfc_normalize({plain})), '[\\p{{L}}\\p{{N}}]+')"


def _grams(words: str, n: int) -> str:
    return f"list_distinct(list_transform(generate_series(1, len({words}) - {n - 1}), lambda i: array_to_string({words}[i:i + {n - 1}], ' ')))"


_P1 = f"""
WITH r AS (SELECT DISTINCT example_id AS id, positive_paper_id AS k, {_SPLIT} AS s, label_source, coalesce(query_text, '') AS x FROM training_examples WHERE example_id IS NOT NULL AND positive_paper_id IS NOT NULL),
w AS (SELECT *, {_words('x')} AS words FROM r WHERE s IS NOT NULL),
g AS (SELECT *, {_grams('words', 3)} AS t FROM w),
pairs AS (SELECT DISTINCT a.id AS train_id, b.id AS eval_id, b.s AS eval_split, b.label_source AS source,
    CASE WHEN a.x = b.x THEN 1.0 ELSE len(list_intersect(a.t, b.t)) / len(b.t) END::DOUBLE AS contained
  FROM g a JOIN g b ON a.k = b.k AND a.s = 'train' AND b.s <> 'train'
  WHERE a.x = b.x OR (len(a.t) > 0 AND len(b.t) > 0 AND 2 * len(list_intersect(a.t, b.t)) >= len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))))
"""
_P3 = f"""
WITH w AS (SELECT id, {_words("coalesce(title, '') || ' ' || coalesce(abstract, '')")} AS words FROM papers WHERE id IS NOT NULL),
g AS (SELECT id, unnest({_grams('words', 3)}) AS t FROM w),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
met AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
SELECT a AS paper_id_a, b AS paper_id_b FROM met JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 2 * c >= x.n + y.n - c
"""
_P3_CLASSES = f"""
WITH RECURSIVE t AS (SELECT id, coalesce(title, '') || ' ' || coalesce(abstract, '') AS x FROM papers WHERE id IS NOT NULL),
reps AS (SELECT x, min(id) AS rep FROM t GROUP BY 1),
w AS (SELECT rep, {_words('x')} AS words FROM reps),
g AS (SELECT rep, unnest({_grams('words', 5)}) AS t FROM w),
n AS (SELECT rep, count(*) AS n FROM g GROUP BY 1),
met AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.rep <> b.rep GROUP BY 1, 2),
near AS (SELECT a, b FROM met JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(a, b) AS (SELECT rep, rep FROM reps UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
classes AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY 1),
degree AS (SELECT a AS rep, count(*) AS links FROM near GROUP BY 1)
SELECT t.id, class_id, coalesce(links, 0) AS links FROM t JOIN reps USING (x) JOIN classes USING (rep) LEFT JOIN degree USING (rep)
"""
_P4 = f"""
WITH RECURSIVE r AS (SELECT DISTINCT example_id AS id, query_paper_id, lower(trim(query_id)) AS q, {_SPLIT} AS s FROM training_examples WHERE example_id IS NOT NULL),
keys AS (SELECT id, 'p' || query_paper_id AS k FROM r WHERE query_paper_id IS NOT NULL UNION SELECT id, 'q' || q FROM r WHERE q IN (SELECT lower(trim(query_id)) FROM manual_queries)),
low AS (SELECT id, k, min(id) OVER (PARTITION BY k) AS first FROM keys),
ties AS (SELECT DISTINCT id AS a, first AS b FROM low UNION SELECT DISTINCT first, id FROM low),
reach(a, b) AS (SELECT id, id FROM r UNION SELECT reach.a, ties.b FROM reach JOIN ties ON ties.a = reach.b),
groups AS (SELECT a AS id, min(b) AS group_id FROM reach GROUP BY 1),
torn AS (SELECT group_id FROM groups JOIN r USING (id) GROUP BY 1 HAVING count(DISTINCT s) > 1)
SELECT id AS example_id, group_id FROM groups WHERE group_id IN (SELECT group_id FROM torn)
"""
_P6 = """
WITH usable AS (SELECT document_id AS id, min(embedding)::DOUBLE[] AS e FROM paper_vectors WHERE document_id IS NOT NULL AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
near AS (SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN a.e = b.e THEN 1.0 ELSE list_cosine_similarity(a.e, b.e) END DESC, b.id) <= 10)
SELECT DISTINCT least(a, b) AS document_id_a, greatest(a, b) AS document_id_b FROM near
"""
_P9 = f"""
WITH d AS (SELECT DISTINCT doc_id, {_words('text')} AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT DISTINCT item_id, {_words('text')} AS words FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
it AS (SELECT item_id, unnest({_grams('words', 3)}) AS t FROM i),
dt AS (SELECT doc_id, t FROM (SELECT doc_id, unnest({_grams('words', 3)}) AS t FROM d) SEMI JOIN it USING (t)),
size AS (SELECT item_id, count(*) AS n FROM it GROUP BY 1),
shared AS (SELECT doc_id, item_id, count(*) AS c FROM dt JOIN it USING (t) GROUP BY 1, 2),
run AS (SELECT doc_id, item_id FROM (SELECT doc_id, unnest({_grams('words', 12)}) AS t FROM d) JOIN (SELECT item_id, unnest({_grams('words', 12)}) AS t FROM i) USING (t))
SELECT doc_id, item_id FROM shared JOIN size USING (item_id) WHERE c >= ceil(0.6 * n - 1e-9) UNION SELECT doc_id, item_id FROM run
"""
SQL = {
    "p1_found": _P1 + "SELECT DISTINCT least(train_id, eval_id) AS example_id_a, greatest(train_id, eval_id) AS example_id_b FROM pairs",
    "p1_report": _P1 + "SELECT eval_split, source, count(DISTINCT eval_id) AS eval_rows, count(DISTINCT train_id) AS train_rows, count(DISTINCT (train_id, eval_id)) AS pairs, round(max(contained), 6) AS most_contained FROM pairs GROUP BY 1, 2",
    "p3_found": _P3,
    "p3_classes": _P3_CLASSES,
    "p4_found": _P4,
    "p6_found": _P6,
    "p9_found": _P9,
}
