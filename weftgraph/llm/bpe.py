"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file's path is a parameter and must exist on every machine; each Python worker loads it once. Long texts are
cut at safe boundaries before they reach the library: between a character that isn't white space and a white space
character no match of the pattern can extend (white space only ever begins a match), and nothing to the left depends on
what follows, so the pieces' ids joined are the ids of the whole. Long runs of white space and of one kind of character
are handled within one piece. Decoding joins the tokens' raw bytes and never passes through a string.

Edge cases: a null text counts as empty (no ids, the digest of no bytes); strings that look like special tokens are
ordinary text; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, trimmed

#: Characters of a piece, from which on the next safe boundary ends it.
PIECE = 1 << 15

_SAFE = regex.compile(r"\S(?=\s)")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut behind characters that white space follows, each piece of ``size`` characters or up to the next one."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size - 1)
        if cut is None:
            break
        out.append(text[at : cut.end()])
        at = cut.end()
    out.append(text[at:])
    return out


def encode(text: str | None, path: str, pattern: str) -> list[int]:
    if not text:
        return []
    enc = encoding(path, pattern)
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def decode(ids, path: str, pattern: str) -> bytes:
    return encoding(path, pattern).decode_bytes(ids)


def encode_table(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with an ``array<int>`` of ids."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        for b in batches:
            ids = [encode(t.as_py(), path, pattern) for t in b.column(text_col)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, out_col])

    return docs.mapInArrow(lambda b: trimmed(run(b)), schema)


def decode_table(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """``tokens`` with the raw bytes its ids stand for; null ids give null."""
    bounded_batches(tokens.sparkSession)
    schema = T.StructType([*tokens.schema.fields, T.StructField(out_col, T.BinaryType())])

    def run(batches):
        for b in batches:
            raw = [None if v is None else decode(v, path, pattern) for v in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=[*b.schema.names, out_col])

    return tokens.mapInArrow(lambda b: trimmed(run(b)), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id, n_tokens, ids_sha256, decoded_sha256``: encodes, decodes the ids and digests both, in one pass."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    schema = T.StructType([src.schema["__id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        for b in batches:
            n, a, z = [], [], []
            for t in b.column("__text"):
                ids = encode(t.as_py(), path, pattern)
                n.append(len(ids))
                a.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                z.append(hashlib.sha256(decode(ids, path, pattern)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], names=["__id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(lambda b: trimmed(run(b)), schema)
