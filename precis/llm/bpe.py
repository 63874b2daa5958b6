"""Byte-level BPE with the tiktoken library and a local rank file.

The rank file is read once on the driver (its size is fixed) and travels with the
UDF, so executors need no copy of it.  Long texts are cut at safe boundaries, where
the pre-splitting pattern always begins a new match, and encoded piece by piece;
decoding joins the raw bytes of the ids, so ids that split a character are fine.
Both directions are row-local Arrow UDFs.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 1 << 16  # characters encoded at once
BATCH = 256  # rows of an Arrow batch worked on at once


@dataclass(frozen=True)
class Vocabulary:
    """Rank file (its bytes) and pre-splitting pattern."""

    ranks: bytes
    pattern: str

    @staticmethod
    def load(path: str, pattern: str) -> "Vocabulary":
        with open(path, "rb") as f:
            return Vocabulary(f.read(), pattern)

    def encoding(self):
        import tiktoken

        pairs = (line.split() for line in self.ranks.splitlines() if line)
        return tiktoken.Encoding(
            "local-ranks", pat_str=self.pattern,
            mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={},
        )


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Pieces of a text of about ``size`` characters, joined: the text.

    A cut lies between a character that is not white space and a blank or line feed.
    No match of the pattern holds white space after another character, and none
    looks further than the white space that follows it, so the matches on both
    sides are those of the whole text.  Without such a place the piece grows.
    """
    start = 0
    while len(text) - start > size:
        cut = -1
        # the last safe place within the size, else the first one behind it
        at = start + size
        while at > start:
            at = max(text.rfind(" ", start + 1, at + 1), text.rfind("\n", start + 1, at + 1))
            if at <= start:
                break
            if not text[at - 1].isspace():
                cut = at
                break
            at -= 1
        if cut < 0:
            at = start + size
            while at < len(text) and (text[at] not in " \n" or text[at - 1].isspace()):
                nxt = [i for i in (text.find(" ", at + 1), text.find("\n", at + 1)) if i >= 0]
                at = min(nxt) if nxt else len(text)
            cut = at
        if cut >= len(text):
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode_text(enc, text: str, size: int = PIECE) -> np.ndarray:
    parts = [np.asarray(enc.encode_ordinary(p), np.int32) for p in safe_pieces(text, size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode(text: Column, vocab: Vocabulary) -> Column:
    """Token ids (array<int>) of every whole text; a null text counts as empty and gives no ids."""

    @F.arrow_udf("array<int>")
    def ids(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = vocab.encoding()
        for a in it:
            for i in range(0, len(a), BATCH):
                rows = [encode_text(enc, t or "") for t in a.slice(i, BATCH).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))

    return ids(text)


def decode(ids: Column, vocab: Vocabulary) -> Column:
    """struct<raw: binary, packed: binary> of an array of ids; null ids give nulls.

    ``raw``: the bytes that the ids stand for.  ``packed``: the ids as little-endian
    unsigned 32-bit integers.
    """

    @F.arrow_udf("struct<raw:binary,packed:binary>")
    def decoded(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = vocab.encoding()
        for a in it:
            for i in range(0, len(a), BATCH):
                rows = [r.values.to_numpy(zero_copy_only=False) if r.is_valid else None for r in a.slice(i, BATCH)]
                yield pa.StructArray.from_arrays([
                    pa.array([None if r is None else enc.decode_bytes(r.tolist()) for r in rows], pa.binary()),
                    pa.array([None if r is None else r.astype("<u4").tobytes() for r in rows], pa.binary()),
                ], ["raw", "packed"])

    return decoded(ids)


def unpack_ids(data: bytes) -> list[int]:
    return [x for (x,) in struct.iter_unpack("<I", data)]
