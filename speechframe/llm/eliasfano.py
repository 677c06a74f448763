"""Token-id files with Elias-Fano document boundaries.

A file holds the ids of a run of documents, in ascending doc_id order, as one
array of 16- or 32-bit integers.  Where each document starts in that array is a
non-decreasing sequence; it is stored as Elias-Fano code (the low bits packed,
the high bits in unary) with a sampled select structure, so that the i-th
offset is read without a table of 64-bit offsets: about 2 + log2(ids/documents)
bits a document.  The doc_ids, ascending too, are coded in the same way.

Layout (little-endian): 8 bytes magic, 8-byte length of a JSON header, header,
then the sections it lists by offset and length.

Defined results: a null or empty text is a document of only the end id; rows
with equal doc_id are all kept, ordered by their text; a null doc_id is stored
as one below the file's smallest id and flagged in the header; an empty table
writes no file and reads back no row.  Files appear whole or not at all, and
only files named in the written manifest are read, so a repeated or lost task
leaves no trace.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_arrow, open_input, open_output, schema

MAGIC = b"EFTOKEN1"
#: Every SAMPLE-th one of the high bits has its position stored.
SAMPLE = 256
#: Ids after which a task starts another file.
FILE_IDS = 1 << 26
#: Chunks that a Python worker remembers, over its tasks.
REMEMBERED = 1_000_000


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = (v[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel()
        ones = ((v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value: a sampled position, then a scan over a bounded number of ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        skip = at % 8
        while True:
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            ones = np.flatnonzero(bits[skip:]) + skip
            if left < len(ones):
                position = byte * 8 + int(ones[left])
                break
            left -= len(ones)
            byte, skip = byte + 64, 0
        low = 0
        if self.low_bits:
            first = i * self.low_bits
            bits = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.low_bits]
            low = int((bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum())
        return (position - i << self.low_bits) | low

    def values(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Values lo..hi, decoded together."""
        hi = self.n if hi is None else hi
        if hi <= lo:
            return np.empty(0, np.int64)
        start = int(self.samples[lo // SAMPLE])
        end = int(self.samples[hi // SAMPLE]) + 1 if hi // SAMPLE < len(self.samples) and hi % SAMPLE == 0 else len(self.high) * 8
        if hi // SAMPLE + 1 < len(self.samples):
            end = int(self.samples[hi // SAMPLE + 1])
        byte = start // 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte : (end + 7) // 8 + 1], bitorder="little")) + byte * 8
        ones = ones[ones >= start][lo % SAMPLE : lo % SAMPLE + hi - lo]
        high = ones - np.arange(lo, hi)
        if not self.low_bits:
            return high.astype(np.int64)
        first, last = lo * self.low_bits, hi * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 : first % 8 + last - first]
        low = bits.reshape(hi - lo, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return (high.astype(np.int64) << self.low_bits) | low

    def sections(self) -> tuple[dict, list[bytes]]:
        return {"n": self.n, "low_bits": self.low_bits}, [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]

    @classmethod
    def read(cls, head: dict, sections: list[bytes]) -> EliasFano:
        low, high = (np.frombuffer(x, np.uint8) for x in sections[:2])
        return cls(head["n"], head["low_bits"], low, high, np.frombuffer(sections[2], "<u4"))


def write_file(uri: str, doc_ids: list[int | None], lengths: list[int], ids: list[bytes], width: int) -> None:
    known = [x for x in doc_ids if x is not None]
    base = min(known, default=0)
    nulls = len(doc_ids) - len(known)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    where = EliasFano.of(starts)
    names = EliasFano.of(np.array([0] * nulls + [x - base + 1 for x in known], dtype=object).astype(np.uint64))
    (wh, ws), (nh, ns) = where.sections(), names.sections()
    parts = [*ws, *ns]
    head = json.dumps({"width": width, "base": base, "starts": wh, "names": nh, "sections": [len(x) for x in parts], "ids": int(starts[-1])}).encode()
    with open_output(uri) as f:
        f.write(MAGIC + len(head).to_bytes(8, "little") + head)
        for x in [*parts, *ids]:
            f.write(x)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        self.f = open_input(uri)
        if self.f.read(8) != MAGIC:
            raise ValueError(f"{uri} is no token-id file")
        head = json.loads(self.f.read(int.from_bytes(self.f.read(8), "little")))
        parts = [self.f.read(n) for n in head["sections"]]
        self.data_at, self.width, self.base = self.f.tell(), head["width"], head["base"]
        self.starts, self.names = EliasFano.read(head["starts"], parts[:3]), EliasFano.read(head["names"], parts[3:])

    def __len__(self) -> int:
        return self.names.n

    def span(self, i: int) -> tuple[int, int]:
        return self.starts.select(i), self.starts.select(i + 1)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        a, b = self.span(i)
        return self.ids(a, b)

    def ids(self, a: int, b: int) -> np.ndarray:
        self.f.seek(self.data_at + a * self.width)
        return np.frombuffer(self.f.read((b - a) * self.width), f"<u{self.width}")

    def doc_ids(self, lo: int, hi: int) -> list[int | None]:
        return [None if x == 0 else int(x) - 1 + self.base for x in self.names.values(lo, hi)]

    def close(self) -> None:
        self.f.close()


@lru_cache(maxsize=1)
def chunk_tokenizer(path: str) -> Callable[[list[str | None]], list[bytes]]:
    """Texts to ids (little-endian 32 bit) with the tokenizers library.

    The vocabulary's splitter drops white space and its normaliser composes
    nothing across ASCII white space, so a text's ids are those of its
    ASCII-space-separated chunks in a row.  A full stop or comma after
    an ASCII letter is a match of its own.  ASCII capitals are lowered first where
    that leaves a composed text composed, as the normaliser would lower them, but
not in a text that spells an added token (``<|endoftext|>``): those are cut out
of the text as written, before it is normalised, as the library does.
    Each distinct chunk of a batch is encoded once; the first ``REMEMBERED`` short
    ones are kept by the Python worker.
    """
    import os
    from unicodedata import is_normalized

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    added = [x.content.lower().encode() for x in own.get_added_tokens_decoder().values()]
    memory: dict[bytes, bytes] = {}
    ends = np.zeros(max(own.get_vocab().values()) + 1, bool)
    ends[[i for w, i in own.get_vocab().items() if w.endswith("</w>")]] = True

    def plain(text: str) -> bytes:
        raw = text.encode()
        low = raw.lower()
        if any(x in low for x in added):  # an added token is one id as it is written, ordinary text in other case
            return raw
        return low if text.isascii() or is_normalized("NFC", text) and is_normalized("NFC", low.decode()) else raw

    def stem(chunk: bytes) -> bytes:
        return chunk[:-1] if chunk[-1:] in (b".", b",") and chunk[-2:-1].isalpha() else chunk

    def fill(look: dict[bytes, bytes], todo: list[bytes]) -> None:
        """Encodes chunks; words of ASCII letters many to a call, told apart by the ids that end a word."""
        words = [c for c in todo if c.isalpha()]
        rest = [c for c in todo if not c.isalpha()]
        groups = [words[at : at + 64] for at in range(0, len(words), 64)]
        for group, e in zip(groups, own.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.asarray(e.ids, "<u4")
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) == len(group):
                raw, at = ids.tobytes(), 0
                for c, cut in zip(group, (cuts * 4).tolist()):
                    look[c] = raw[at:cut]
                    at = cut
            else:
                rest += group
        for at in range(0, len(rest), 4096):
            for c, e in zip(rest[at : at + 4096], own.encode_batch_fast([c.decode() for c in rest[at : at + 4096]], add_special_tokens=False)):
                look[c] = np.asarray(e.ids, "<u4").tobytes()

    def encode(texts: list[str | None]) -> list[bytes]:
        chunks = [plain(x or "").split() for x in texts]
        found = [list(map(memory.get, x)) for x in chunks]
        holes = []
        for x, f in zip(chunks, found):
            at = -1
            for _ in range(f.count(None)):
                at = f.index(None, at + 1)
                holes.append((f, at, x[at]))
        new = {c for _, _, c in holes}
        extra: dict[bytes, bytes] = {}
        fill(extra, list({y for c in new for y in (stem(c), c[len(stem(c)) :]) if y and y not in memory}))
        for c in new:
            s = stem(c)
            if len(s) < len(c):
                extra[c] = (extra[s] if s in extra else memory[s]) + (extra[c[-1:]] if c[-1:] in extra else memory[c[-1:]])
        for f, at, c in holes:
            f[at] = extra[c]
        if len(memory) < REMEMBERED:  # what comes early and often stays; later rare chunks are worked out again
            memory.update((c, x) for c, x in extra.items() if len(c) <= 64)
        return [b"".join(f) for f in found]

    return encode


def write_tokens(docs: DataFrame, out_dir: str, path: str, end_id: int = 1, width: int = 2) -> DataFrame:
    """Writes files in ascending doc_id order; returns the manifest (file, docs, ids, seq) as read from storage.

    ``docs``: doc_id, text.  ``width``: bytes an id takes (2 holds ids below 65,536).
    Documents are dealt by doc_id ranges, each range one task and one or more files.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    kind = schema("file string,first long,part int,seq int,docs long,ids long")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = chunk_tokenizer(path)
        part = TaskContext.get().partitionId()
        names: list[int | None] = []
        lengths: list[int] = []
        ids: list[bytes] = []
        seq = total = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, total
            uri = f"{out_dir}/part-{part:05d}-{seq:04d}-{uuid.uuid4().hex}.eft"
            write_file(uri, names, lengths, ids, width)
            row = [[uri], [next((x for x in names if x is not None), None)], [part], [seq], [len(names)], [total]]
            names.clear(), lengths.clear(), ids.clear()
            seq, total = seq + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(row, arrow)], schema=arrow)

        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                for doc, got in zip(piece.column(0).to_pylist(), encode(piece.column(1).to_pylist())):
                    row = np.frombuffer(got + end, "<u4")
                    if int(row.max()) >= 1 << 8 * width:
                        raise ValueError(f"an id doesn't fit in {width} bytes")
                    names.append(doc)
                    lengths.append(len(row))
                    ids.append(row.astype(f"<u{width}").tobytes())
                    total += len(row)
                    if total >= FILE_IDS:
                        yield flush()
        if names:
            yield flush()

    map_arrow(dealt, run, kind).write.parquet(f"{out_dir}/manifest")
    return spark.read.schema(kind).parquet(f"{out_dir}/manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of the manifest's files: doc_id, start (ids before it in the whole collection), n_tokens, ids_crc32 and, unless left out, ids.

    The window below has a row a file (not a document): it turns the files' id counts into global starts.
    """
    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("ids").over(w), F.lit(0)).cast("long"))
    n = max(1, manifest.count())
    out = schema("doc_id long,start long,n_tokens long,ids_crc32 long" + (",ids ints" if with_ids else ""))
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                r = Reader(uri)
                for lo in range(0, len(r), 1024):
                    hi = min(len(r), lo + 1024)
                    at = r.starts.values(lo, hi + 1)
                    rows = [r.ids(a, b).astype("<u4") for a, b in zip(at.tolist(), at[1:].tolist())]
                    columns = [r.doc_ids(lo, hi), at[:-1] + before, np.diff(at), [zlib.crc32(x.tobytes()) for x in rows]] + ([[x.astype(np.int32) for x in rows]] if with_ids else [])
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(columns, arrow)], schema=arrow)
                r.close()

    return map_arrow(files.select("file", "before").repartition(n), run, out)
