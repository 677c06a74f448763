"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is cut into halves down to leaves; each node holds the ids of its span.
Two neighbours are joined by re-encoding a window around their border, which
grows on either side until its edge is a place where the encoding provably
cannot change: a non-space before it and white space after it.  No match of the
splitting pattern spans such a place, none looks past it (its only look-ahead
belongs to white-space runs, which cannot end there), and BPE never merges
across matches, so the tokens outside the window stand whatever is joined
later.  The operation is associative.  Decoding concatenates the pieces up a
tree of the same form.

That proof reads the splitting pattern, so it holds for ``SPLIT`` alone: texts
are encoded in one leaf where another pattern is given.

Defined results: a null or empty text has no ids; decoding no ids gives b"";
an id outside the vocabulary raises.  Extra columns pass through untouched.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

#: Characters of a leaf; characters by which a window first grows (then twice as many each time); ids of a leaf in decoding.
LEAF, GROW, LEAF_IDS = 256, 32, 256
#: The pattern that stable places are proven for: its alternatives in any order of the contractions. Fixed values.
SPLIT = ("'s|'t|'re|'ve|'m|'ll|'d", r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+", r"\s+(?!\S)", r"\s+")
#: The White_Space property of Unicode, which \s means in the splitting pattern. Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STABLE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """tiktoken on leaves, the monoid above them."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        table = ranks(path)
        self.most = LEAF if pattern == "|".join(SPLIT) else None
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.width = [0] * (max(table.values(), default=-1) + 1)
        for piece, i in table.items():
            self.width[i] = len(piece)

    def edge(self, text: str, at: int, end: int) -> int:
        """A stable place near ``at`` towards ``end`` (a span's own end), looked for in a growing window; first a plain space after a letter, as most are."""
        p = text.rfind(" ", max(end, at - GROW), at + 1) if end <= at else text.find(" ", at, min(end, at + GROW))
        if p > 0 and not text[p - 1].isspace():
            return p
        step = GROW
        while True:
            if end <= at:
                low = max(end, at - step)
                places = [m.start() for m in STABLE.finditer(text, max(0, low - 1), min(len(text), at + 1)) if low <= m.start() <= at]
                if places:
                    return places[-1]
                if low == end:
                    return end
            else:
                high = min(end, at + step)
                m = next((m for m in STABLE.finditer(text, max(0, at - 1), min(len(text), high + 1)) if at <= m.start() <= high), None)
                if m:
                    return m.start()
                if high == end:
                    return end
            step *= 2

    def count(self, ids: list[int], size: int, back: bool) -> int:
        """How many ids at one end stand for ``size`` bytes."""
        n = 0
        while size > 0:
            size -= self.width[ids[-1 - n] if back else ids[n]]
            n += 1
        assert size == 0, "a stable place lies inside a token"
        return n

    def join(self, text: str, lo: int, mid: int, hi: int, a: list[int], b: list[int]) -> list[int]:
        p, q = self.edge(text, mid, lo), self.edge(text, mid, hi)
        if p == q:
            return a + b
        drop = self.count(a, len(text[p:mid].encode()), True)
        skip = self.count(b, len(text[mid:q].encode()), False)
        return a[: len(a) - drop] + self.leaf(text[p:q]) + b[skip:]

    def tree(self, text: str, lo: int, hi: int) -> list[int]:
        if self.most is None or hi - lo <= self.most:
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self.tree(text, lo, mid), self.tree(text, mid, hi))

    def encode(self, text: str | None) -> list[int]:
        return self.tree(text, 0, len(text)) if text else []


def decode_tree(ids: list[int], pieces: list[bytes], lo: int = 0, hi: int | None = None) -> bytes:
    hi = len(ids) if hi is None else hi
    if hi - lo <= LEAF_IDS:
        return b"".join([pieces[i] for i in ids[lo:hi]])
    mid = (lo + hi) // 2
    return decode_tree(ids, pieces, lo, mid) + decode_tree(ids, pieces, mid, hi)


def pieces_of(path: str) -> list[bytes]:
    """Bytes by id; ids that the vocabulary lacks are b""."""
    table = ranks(path)
    pieces = [b""] * (max(table.values(), default=-1) + 1)
    for piece, i in table.items():
        pieces[i] = piece
    return pieces


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Adds ``out_col`` array<int>: the ids of every whole text; with ``decoded_col`` also the bytes that those ids decode to, in the same Python worker."""
    new = [T.StructField(out_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_col, T.BinaryType())] if decoded_col else [])
    kept = [c for c in df.columns if c not in (out_col, decoded_col)]
    kind = T.StructType([df.schema[c] for c in kept] + new)

    def make():
        encoder = Encoder(path, pattern)
        pieces = pieces_of(path) if decoded_col else []

        def f(batch: pa.RecordBatch) -> list:
            got = [encoder.encode(x) for x in batch.column(text_col).to_pylist()]
            offsets = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(x) for x in got], out=offsets[1:])
            values = np.fromiter(chain.from_iterable(got), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)).cast(pa.list_(pa.int32()))
            return [batch.column(c) for c in kept] + [ids] + ([[decode_tree(x, pieces) for x in got]] if decoded_col else [])

        return f

    return map_rows(df, kind, make, 256)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col`` binary: the bytes that the ids stand for."""
    kept = [c for c in df.columns if c != out_col]
    kind = T.StructType([df.schema[c] for c in kept] + [T.StructField(out_col, T.BinaryType())])

    def make():
        pieces = pieces_of(path)

        def f(batch: pa.RecordBatch) -> list:
            return [batch.column(c) for c in kept] + [[decode_tree(x or [], pieces) for x in batch.column(ids_col).to_pylist()]]

        return f

    return map_rows(df, kind, make, 256)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows with ids and decoded."""
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    return df.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", ids.cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )
