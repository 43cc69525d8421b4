"""Languages of documents and of the segments of mixed documents, with confidences."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.ppm import Model, text_words
from quillspark.llm.shingles import parts
from quillspark.runtime import ship_package

LANGUAGES = ["de", "en", "es", "fr", "it", "pt"]
#: Codes and names of each language, as labels spell them.
LABELS = {
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "it": ["it", "ita", "italian", "italiano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
}
#: Labelled rows used for fitting, per language, chosen by hash: a fixed bound whatever the size of the table.
SAMPLE_ROWS = 300
#: Bits that a change of language between two sentences costs, and the least bits per byte that a segment must gain.
SWITCH_BITS = 24.0
#: Text coded worse than this many bits per byte in its best language is no prose of any of them.
PROSE_BITS = 4.2
#: Least words of a sentence that can decide a language by itself.
SENTENCE_WORDS = 4
_SENTENCE = re.compile(r"(?<=[.!?…])(?:<[^<>]*>|\[\d+\]|[*\"'»”)\]])*\s+|\n\s*\n")


def label_language(col: str):
    """The language that a label names, by code with or without region or by English or own name; else null."""
    plain = F.regexp_replace(F.lower(F.trim(F.col(col))), r"^([a-z]{2,3})[-_].*$", "$1")
    return F.create_map(*[F.lit(x) for k, names in LABELS.items() for n in names for x in (n, k)])[plain]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text; line breaks that open a long line or a paragraph end one, too."""
    out, start = [], 0
    for m in _SENTENCE.finditer(text):
        out.append((start, m.start()))
        start = m.end()
    out.append((start, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def _prose(words: list[str], text: str) -> bool:
    letters = sum(map(len, words))
    visible = sum(1 for c in text if not c.isspace())
    return len(words) >= SENTENCE_WORDS and letters >= 0.5 * visible and letters >= 2.5 * len(words)


def segments(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, int, float, int]]]:
    """For each text (start, end, language, confidence, sentences) of its runs of one language.

    Sentences are scored by exact code length; the cheapest path over languages, where each change costs SWITCH_BITS,
    gives the runs. Sentences without prose take no part and belong to the run around them. Confidence is the posterior
    of the language over the run, with the gain spread over the square root of its words so that it does not saturate.
    """
    spans, sizes, flat, owner, lengths = [], [], [], [], []
    for i, text in enumerate(texts):
        if not text or text.isspace():
            continue
        text = unicodedata.normalize("NFC", text)
        for a, b in sentences(text):
            words = text_words(text[a:b])
            if _prose(words, text[a:b]):
                spans.append((a, b)), owner.append(i), sizes.append(len(words)), lengths.append(sum(map(len, words)) + len(words))
                flat.extend(words)
    out: list[list[tuple[int, int, int, float, int]]] = [[] for _ in texts]
    if not spans:
        return out
    bits = np.add.reduceat(model.word_costs(flat), np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
    fine = np.flatnonzero(bits.min(axis=1) <= PROSE_BITS * np.array(lengths))
    owner = np.array(owner)[fine]
    for i in np.unique(owner):
        mine = fine[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]
        costs = bits[mine]
        path = _cheapest_path(costs)
        cuts = np.r_[0, np.flatnonzero(path[1:] != path[:-1]) + 1, len(path)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            total, n = costs[lo:hi].sum(axis=0), sum(sizes[k] for k in mine[lo:hi])
            weight = np.exp2(-(total - total.min()) / max(1.0, n**0.5))
            out[i].append((spans[mine[lo]][0], spans[mine[hi - 1]][1], int(path[lo]), float(weight[path[lo]] / weight.sum()), int(hi - lo)))
    return out


def _cheapest_path(costs: np.ndarray) -> np.ndarray:
    """Language of each sentence on the path of least total bits."""
    first = costs.argmin(axis=1)
    if (first == first[0]).all():
        return first
    best, back = costs[0].copy(), []
    for c in costs[1:]:
        back.append(np.where(best <= best.min() + SWITCH_BITS, np.arange(len(best)), int(best.argmin())))
        best = np.minimum(best, best.min() + SWITCH_BITS) + c
    path = [int(best.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def fit_models(df: DataFrame, key: str, text: str, lang: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit the trees on at most ``sample_rows`` labelled rows per language, chosen by a hash of the key. Labels may be
    wrong: after a first fit, rows that another language codes shorter are dropped and the trees are fitted again."""
    rows = df.where(F.col(text).isNotNull() & (F.length(text) >= 80)).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), label_language(lang).alias("l")).where("l is not null")
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    share = F.create_map(*[F.lit(x) for l in LANGUAGES for x in (l, float(min(1.0, 1.3 * sample_rows / max(1, counts.get(l, 0)))))])
    drawn = rows.where(F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 30)) <= share[F.col("l")] * float(1 << 30)).toPandas().sort_values(["l", "k"]).groupby("l").head(sample_rows)
    texts = {l: [[x for a, b in sentences(t) if (x := text_words(t[a:b]))] for t in (unicodedata.normalize("NFC", t) for t in drawn["t"][drawn["l"] == l])] for l in LANGUAGES}
    lines = {l: [x for t in texts[l] for x in t] for l in LANGUAGES}
    kept = lines
    for _ in range(2):
        model = Model(LANGUAGES, [dict(Counter(w for x in kept[l] for w in x)) for l in LANGUAGES])
        # a sentence counts for its label if that language codes it shortest
        following = {}
        for c, l in enumerate(LANGUAGES):
            sizes = [len(x) for x in lines[l]]
            bits = np.add.reduceat(model.word_costs([w for x in lines[l] for w in x]), np.r_[0, np.cumsum(sizes)[:-1]], axis=0) if sizes else np.zeros((0, len(LANGUAGES)))
            following[l] = [x for x, best in zip(lines[l], bits.argmin(axis=1)) if best == c]
        kept = following
    return Model(LANGUAGES, [dict(Counter(w for x in kept[l] for w in x)) for l in LANGUAGES])


SCHEMA = "key bigint, start int, end int, lang string, confidence double, sentences int, whole boolean"


def document_segments(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, start, end, lang, confidence, sentences, whole): one row per language run of every document; whole marks the
    only run of its text. Offsets count characters of the NFC text. Null, blank and non-prose texts give no row. One
    narrow pass; the frozen trees are broadcast, and their size is bounded by the fitting sample."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for part in parts(b, 1):
                rows = []
                for k, found in zip(part.column(0).to_pylist(), segments(m, part.column(1).to_pylist())):
                    rows.extend((k, a, e, m.names[c], p, n, len(found) == 1) for a, e, c, p, n in found)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_()))], ["key", "start", "end", "lang", "confidence", "sentences", "whole"])

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


def unnamed_languages(df: DataFrame, key: str, text: str, lang: str, model: Model) -> DataFrame:
    """(key, lang): languages of a whole text, or of at least two consecutive sentences of it, that its label does not
    name. Labels that name no language leave every language of the text unnamed."""
    found = document_segments(df, key, text, model).where("whole or sentences >= 2").select("key", F.col("lang").alias("found"))
    labels = df.select(F.col(key).cast("bigint").alias("key"), label_language(lang).alias("label"))
    met = found.join(labels, "key").where(F.col("label").isNull() | (F.col("label") != F.col("found")))
    return met.select(F.col("key").alias(key), F.col("found").alias("lang")).distinct()


def document_languages(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, lang, confidence): the language of most sentences of each document; documents without prose have null and 0."""
    runs = document_segments(df, key, text, model)
    by = runs.groupBy("key", "lang").agg(F.sum("sentences").alias("n"), F.max("confidence").alias("confidence"))
    most = by.groupBy("key").agg(F.max(F.struct("n", "confidence", "lang")).alias("m"))
    out = df.select(F.col(key).cast("bigint").alias("key")).distinct().join(most, "key", "left")
    return out.select(F.col("key").alias(key), F.col("m.lang").alias("lang"), F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"))
