import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.bpe_stream import Decoder, Transducer, read_ranks
from quillspark.llm.tokens import DEFAULT_RANKS, decode_corpus, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_RANKS), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def machines():
    import tiktoken

    from quillspark.llm.bpe_stream import SPLIT_PATTERN

    with open(DEFAULT_RANKS, "rb") as f:
        ranks = read_ranks(f.read())
    return Transducer(ranks), Decoder(ranks), tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80), st.integers(4, 40))
def test_equals_reference_encoder_and_round_trips(machines, text, chunk):
    encoder, decoder, known = machines
    ids = encoder.encode(text)
    assert ids == known.encode_ordinary(text)
    assert encoder.encode(text, chunk=chunk) == ids
    assert decoder.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 5000, "=-" * 2000, " " * 3000 + "x", "日本" * 1500, "the" * 2000, "-=_ " * 900, "<|endoftext|>"])
def test_long_runs_keep_a_bounded_window(machines, text):
    encoder, _, known = machines
    assert encoder.encode(text) == known.encode_ordinary(text)


def test_small_merge_list_by_hand():
    lines = [(b"a", 0), (b"b", 1), (b"ab", 2), (b"aba", 3)]
    ranks = read_ranks(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in lines))
    assert Transducer(ranks).encode("abab") == [2, 2]  # the pair ab comes first in the list, so aba is never built


def test_table(spark, machines):
    rows = [(1, "Hello world", 9), (2, None, 9), (3, "", 9), (3, "", 9), (4, "x" * 200_000, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = encode_corpus(df)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert out.count() == 5 and out.columns == ["doc_id", "text", "ids"]
    assert got[2] == got[3] == [] and got[1] == machines[2].encode_ordinary("Hello world") and got[4] == machines[2].encode_ordinary("x" * 200_000)
    back = {r["doc_id"]: r["decoded"] for r in decode_corpus(out).collect()}
    assert back[1] == "Hello world" and back[2] == ""
    assert encode_corpus(df.limit(0)).count() == 0
