import random

import numpy as np
import pytest

from quillspark.llm.languages import LANGUAGES, document_languages, document_segments, fit_models, label_language, segments, sentences, unnamed_languages
from quillspark.llm.ppm import Model

SAMPLES = {
    "de": "der alte Mann geht heute mit seinem Hund durch den Wald und sieht viele kleine Vögel".split(),
    "en": "the old man walks today with his dog through the forest and sees many small birds there".split(),
    "es": "el hombre viejo camina hoy con su perro por el bosque y mira muchos pájaros pequeños allí".split(),
    "fr": "le vieil homme marche aujourd'hui avec son chien dans la forêt et regarde beaucoup de petits oiseaux".split(),
    "it": "il vecchio uomo cammina oggi con il suo cane nella foresta e guarda molti piccoli uccelli lassù".split(),
    "pt": "o homem velho caminha hoje com o seu cão pela floresta e olha muitos pássaros pequenos ali".split(),
}


def sentence(rng, lang):
    return " ".join(rng.choice(SAMPLES[lang]) for _ in range(12)).capitalize() + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = []
    for k in range(360):
        lang = LANGUAGES[k % 6]
        label = lang if rng.random() < 0.9 else rng.choice(LANGUAGES)
        rows.append((k, " ".join(sentence(rng, lang) for _ in range(5)), label, lang))
    return spark.createDataFrame([(k, t, label, 1) for k, t, label, _ in rows], "doc_id bigint, text string, lang string, found int"), rows


def test_code_lengths_match_a_plain_tree():
    words = {"abab": 3, "abc": 1, "ba": 2}
    m = Model(["x"], [words], order=2)

    def cost(context, symbol, k):
        if k < 0:
            return 8.0
        c = context[len(context) - k :] if k else ""
        seen = {}
        for w, n in words.items():
            t = " " + w
            for i in range(k, len(t)):
                if t[i - k : i] == c:
                    seen[t[i]] = seen.get(t[i], 0) + n
        total, kinds = sum(seen.values()), len(seen)
        if symbol in seen:
            return -np.log2(seen[symbol] / (total + kinds))
        return (-np.log2(kinds / (total + kinds)) if kinds else 0.0) + cost(context, symbol, k - 1)

    for w in ["abab", "abca", "zq", "b"]:
        t = " " + w
        want = sum(cost(t[:i], t[i], min(2, i)) for i in range(len(t)))
        assert m.word_costs([w])[0, 0] == pytest.approx(want, abs=1e-3)


def test_sentences_and_labels(spark):
    text = 'Erster Satz hier. "Zweiter Satz." Dritter\nSatz 3.5 geht weiter.\n\nVierter ohne Punkt'
    assert [text[a:b] for a, b in sentences(text)] == ["Erster Satz hier.", '"Zweiter Satz.', "Dritter\nSatz 3.5 geht weiter.", "Vierter ohne Punkt"]
    labels = [("de-AT", "de"), ("ENGLISH ", "en"), ("español", "es"), ("pt_PT", "pt"), ("und", None), ("", None), (None, None), ("xx", None), ("fra", "fr")]
    got = spark.createDataFrame(labels, "lang string, want string").select(label_language("lang").alias("g"), "want").collect()
    assert [r["g"] for r in got] == [r["want"] for r in got]


def test_found_and_segments(spark, docs):
    df, rows = docs
    model = fit_models(df, "doc_id", "text", "lang")
    got = {(r["doc_id"], r["lang"]) for r in unnamed_languages(df, "doc_id", "text", "lang", model).collect()}
    assert got == {(k, lang) for k, _, label, lang in rows if label != lang}
    rng = random.Random(11)
    mixed = " ".join([sentence(rng, "en") for _ in range(3)] + [sentence(rng, "it") for _ in range(2)] + [sentence(rng, "en")])
    odd = [(1, mixed, "en"), (2, None, "en"), (3, " \n\t", None), (4, "1;2;3|4 5.6\n7", "de"), (5, "x1 = f8(x0, 44) # 1\nx2 = f2(x0, 35) # 2", "de"), (6, sentence(rng, "de") * 4000, None), (7, "", "fr"), (1, mixed, "en")]
    extra = spark.createDataFrame(odd, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS key", "2 AS sentences")
    assert {(r["doc_id"], r["lang"]) for r in unnamed_languages(extra, "doc_id", "text", "lang", model).collect()} == {(1, "it"), (6, "de")}
    runs = [(r["lang"], r["sentences"]) for r in document_segments(extra.where("doc_id = 1").limit(1), "doc_id", "text", model).orderBy("start").collect()]
    assert runs == [("en", 3), ("it", 2), ("en", 1)]
    langs = {r["doc_id"]: (r["lang"], r["confidence"]) for r in document_languages(extra, "doc_id", "text", model).collect()}
    assert langs[1][0] == "en" and langs[2] == (None, 0.0) and langs[6][0] == "de" and 0 < langs[1][1] <= 1
    assert unnamed_languages(extra.limit(0), "doc_id", "text", "lang", model).count() == 0
    assert segments(model, [None, ""]) == [[], []]


def test_no_labels_at_all(spark):
    df = spark.createDataFrame([(1, "some words here in a row", None)], "doc_id bigint, text string, lang string")
    model = fit_models(df, "doc_id", "text", "lang")
    assert unnamed_languages(df, "doc_id", "text", "lang", model).count() <= 1
