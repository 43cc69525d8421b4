"""Encoding of a whole corpus with a public byte-level vocabulary."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bpe_stream import Decoder, Transducer, read_ranks
from quillspark.runtime import ship_package

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_machines: dict[int, Transducer | Decoder] = {}


def _machine(kind, broadcast):
    key = (kind.__name__, broadcast.id if hasattr(broadcast, "id") else id(broadcast))
    if key not in _machines:
        _machines.clear()
        _machines[key] = kind(read_ranks(broadcast.value))
    return _machines[key]


def _ranks_broadcast(df: DataFrame, path: str):
    """The vocabulary file, whose size does not depend on the data (under 1 MB for 50k tokens)."""
    ship_package(df.sparkSession)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = DEFAULT_RANKS) -> DataFrame:
    """Add ``out``, the token ids of ``text`` as array<int>, without special tokens.

    Null and empty texts give the empty list; strings that look like special tokens are ordinary text; texts of any
    length are encoded whole, in chunks, with constant memory. One narrow pass: no shuffle. A column named ``out``
    that is there already is replaced. Repeated rows keep their rows.
    """
    if not os.path.exists(vocabulary):
        raise FileNotFoundError(vocabulary)
    ranks = _ranks_broadcast(df, vocabulary)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _machine(Transducer, ranks)
        for texts in batches:
            flat, offsets = [], [0]
            for t in texts.to_pylist():
                flat.extend(machine.encode(t))
                offsets.append(len(flat))
            yield pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), pa.array(np.asarray(flat, np.int32)))

    return df.withColumn(out, ids(F.col(text).cast("string")))


def decode_corpus(df: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary: str = DEFAULT_RANKS) -> DataFrame:
    """Add ``out``, the text of the token ids; null stays null and the empty list gives the empty text."""
    ranks = _ranks_broadcast(df, vocabulary)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _machine(Decoder, ranks)
        for lists in batches:
            yield pa.array([None if x is None else machine.decode(x) for x in lists.to_pylist()], pa.string())

    return df.withColumn(out, texts(F.col(ids)))
