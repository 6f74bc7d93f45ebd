"""Byte-level BPE encoding and decoding with a rank file (operator 1).

``encode(text)`` and ``decode(ids)`` are column functions backed by the
tiktoken library.  The rank file is read once on the driver and travels to
the executors with the function, so executors need no copy of it.

Long texts are cut before encoding, at places where the split pattern ends a
match whatever surrounds it: between a letter, digit or punctuation mark and
a space or line feed, and between an ASCII letter and an ASCII digit.  No
alternative of the pattern spans such a place and none looks across it (the
only look-ahead follows white space), so the parts give the same ids as the
whole text.  A stretch without such a place is encoded as it is.

Defined results: null text encodes as the empty text (no ids); null ids
decode to null; an id that is not in the rank file raises ``KeyError``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Texts beyond this many characters are encoded in parts.
PART_CHARS = 1 << 16
#: A place where every match of the pattern ends.
SAFE = r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"

ENCODED = "struct<ids: array<int>, decoded: binary>"


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank)
             for token, rank in map(bytes.split, ranks.splitlines()) }
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=1)
def _safe():
    import regex

    return regex.compile(SAFE)


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """``text`` cut at safe places, into parts of about ``size`` characters."""
    out, start = [], 0
    while len(text) - start > size:
        place = _safe().search(text, start + size)
        if place is None:
            break
        out.append(text[start:place.start()])
        start = place.start()
    out.append(text[start:])
    return out


def encode_text(encoding, text: str, size: int = PART_CHARS) -> list[int]:
    """Ids of one text, special tokens being ordinary text."""
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    return [i for part in parts(text, size) for i in encoding.encode_ordinary(part)]


def read_ranks(path: str) -> bytes:
    """The bytes of a local rank file (lines of base64 token and rank)."""
    with open(path, "rb") as f:
        return f.read()


def _id_lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.fromiter((i for ids in rows for i in ids), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encoder(rank_file: str, pattern: str, part_chars: int = PART_CHARS):
    """Column function: text -> ``array<int>`` of token ids."""
    ranks = read_ranks(rank_file)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(ranks, pattern)
        for texts in batches:
            yield _id_lists([encode_text(encoding, t or "", part_chars) for t in texts.to_pylist()])

    return encode


def decoder(rank_file: str, pattern: str):
    """Column function: ``array<int>`` -> ``binary``, the bytes of all tokens.

    The result is bytes, since a cut list of ids may end inside a character.
    """
    ranks = read_ranks(rank_file)

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(ranks, pattern)
        for rows in batches:
            yield pa.array([None if ids is None else encoding.decode_bytes(ids)
                            for ids in rows.to_pylist()], pa.binary())

    return decode


def ids_sha256(ids: Column) -> Column:
    """Digest of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str,
                     part_chars: int = PART_CHARS) -> DataFrame:
    """``docs`` reduced to ``doc_id, ids, decoded``, one row per input row.

    Nothing is shuffled: rows stay where they are read.  Null text counts as
    empty, repeated rows each give a row, and further columns are ignored.
    """
    prepare(docs.sparkSession)
    encode = encoder(rank_file, pattern, part_chars)
    decode = decoder(rank_file, pattern)
    return (docs.select("doc_id", encode(F.col("text").cast("string")).alias("ids"))
            .select("doc_id", "ids", decode("ids").alias("decoded")))
