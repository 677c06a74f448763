"""WARC archives: writing with segmented records, and reading with segment reassembly.

A response's block is an HTTP head and the payload in chunked transfer framing.
A block longer than ``segment_bytes`` is cut into a first record (segment 1)
and continuation records that name it as their origin; the last one carries
the total length.  Reading parses the files record by record, deals the
segments by origin, orders them by number, checks that none is missing and that
their length is the stated total, joins them and decodes the chunked framing.

Defined results: a null html is an empty payload; null urls are written as an
empty target; rows with the same payload and the largest page_id are all
responses if that id repeats; an empty table makes no archive and no row.  A
record whose segments don't add up, whose framing is broken, or whose lengths
or segment number are no numbers or not met, is returned with status
"incomplete" and null payload columns, never dropped.  A block is bounded by the
gzip member (or plain file) that it begins in: one whose length isn't met, or
after which neither the end nor a record comes, is incomplete, and reading goes
on at the next line that starts a record.  A damaged member, or bytes between
members (but zeros, which are padding), that no record can be read from, gives
one row of type "damaged" without an id, and reading goes on at the next member.
Files appear whole or not at all and are read by the manifest that successful
tasks wrote, so repeated or lost tasks leave no trace.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_lineage, map_arrow, open_input, open_output, schema, spread_join

SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES = 32 << 10, 8 << 10, 256 << 20
#: The type of rows that stand for bytes that no record could be read from.
DAMAGED = "damaged"
DATE = "2024-01-01T00:00:00Z"
#: The head field that announces chunked framing (the last coding named), in any spelling of case and space.
CHUNKED = re.compile(rb"(?im)^transfer-encoding[ \t]*:(?:[^\r\n]*,)?[ \t]*chunked[ \t]*\r?$")
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        digits = body[at:end].split(b";")[0].strip(b" \t")
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", digits):
            raise ValueError("a chunk without a size")
        size = int(digits, 16)
        at = end + 2
        if size == 0:
            break
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2
    return b"".join(parts)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, block: bytes, fields: list[tuple[str, object]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(key: str, url: str, payload: bytes, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    digest, name = ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), f"urn:page:{key}"
    target = ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))
    size = ("WARC-Payload-Length", len(payload))
    if refers_to is not None:
        yield record("revisit", name, b"HTTP/1.1 200 OK\r\n\r\n", [target, digest, size, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http; msgtype=response")])
        return
    block = HTTP_HEAD + chunked(payload)
    common = [target, digest, size, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        yield record("response", name, block, common)
        return
    starts = range(0, len(block), segment_bytes)
    for n, at in enumerate(starts, 1):
        piece = block[at : at + segment_bytes]
        if n == 1:
            yield record("response", name, piece, [*common, ("WARC-Segment-Number", 1)])
        else:
            last = [("WARC-Segment-Total-Length", len(block))] if n == len(starts) else []
            yield record("continuation", f"{name}:segment:{n}", piece, [target, ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", n), *last])


def revisits(pages: DataFrame, dedupe_from: int = 0) -> DataFrame:
    """(key, sha, refers_to) of the pages whose payload another page with a larger id has. Narrow rows only are shuffled."""
    ids = pages.where(F.col("size") >= dedupe_from).select("page_id", "key", "sha")
    kept = cut_lineage(ids.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null"))
    return spread_join(ids, kept, "sha", "n", ["key"]).where("page_id is null or page_id < refers_to").select("key", "sha", "refers_to").distinct()


def write_warc(pages: DataFrame, out_dir: str, dedupe_from: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes a record (or its segments) per row of (page_id, url, html); returns the manifest (file, records) as read from storage."""
    spark = pages.sparkSession
    page_id = F.col("page_id").cast("long")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(page_id.alias("page_id"), F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("null")), F.left(F.sha1(body), F.lit(16))).alias("key"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.alias("payload"), F.octet_length(body).alias("size"), F.unhex(F.sha1(body)).alias("sha"))
    full = rows.join(revisits(rows, dedupe_from), ["key", "sha"], "left").select("key", "url", "payload", F.concat(F.col("refers_to").cast("string"), F.lit(":"), F.substring_index("key", ":", -1)).alias("refers_to"))
    kind = schema("file string,records long")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = ((b, i) for b in batches for i in range(b.num_rows))
        row = next(todo, None)
        while row is not None:
            uri, n, size = f"{out_dir}/{uuid.uuid4().hex}.warc.gz", 0, 0
            with open_output(uri) as f:
                f.write(zlib_member(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")])))
                while row is not None and size < FILE_BYTES:
                    b, i = row
                    key, url, payload, refers = (b.column(c)[i].as_py() for c in range(4))
                    for x in page_records(key, url, payload, refers, segment_bytes):
                        size += f.write(zlib_member(x))
                        n += 1
                    row = next(todo, None)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], schema=arrow)

    map_arrow(full, run, kind).write.parquet(f"{out_dir}/manifest")
    return spark.read.schema(kind).parquet(f"{out_dir}/manifest")


def zlib_member(data: bytes) -> bytes:
    """A gzip member of its own, as WARC readers expect a record."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Raw:
    """A seekable file, read in chunks, by position."""

    CHUNK, PIECE = 1 << 18, 1 << 14

    def __init__(self, f):
        self.f, self.start, self.chunk = f, 0, b""
        self.size = f.seek(0, 2)

    def piece(self, at: int) -> bytes:
        """PIECE bytes from there on, fewer at the end only."""
        end = self.start + len(self.chunk)
        if not self.start <= at <= end or (end - at < self.PIECE and end < self.size):
            self.f.seek(at)
            self.start, self.chunk = at, self.f.read(self.CHUNK)
        return self.chunk[at - self.start : at - self.start + self.PIECE]


class Stream:
    """The bytes of one gzip member, or of a plain file, a piece at a time. ``broken``: the member is damaged or cut short."""

    def __init__(self, raw: Raw, at: int, packed: bool):
        self.raw, self.at, self.buffer, self.over, self.broken = raw, at, bytearray(), False, False
        self.z = zlib.decompressobj(31) if packed else None

    def more(self) -> bool:
        if self.over:
            return False
        data = self.raw.piece(self.at)
        if not data:
            self.over, self.broken = True, self.z is not None
            return False
        if self.z is None:
            self.at += len(data)
            self.buffer += data
            return True
        try:
            self.buffer += self.z.decompress(data)
        except zlib.error:
            self.over = self.broken = True
            return False
        self.at += len(data) - len(self.z.unused_data)
        self.over = self.z.eof
        return True

    def line(self) -> bytes | None:
        """Up to and with the next line feed; None at the end."""
        seen = 0
        while (at := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self.more():
                return None
        out = bytes(self.buffer[: at + 1])
        del self.buffer[: at + 1]
        return out

    def block(self, size: int) -> bytes | None:
        """The next ``size`` bytes, if there are so many and the end or another record follows them; else None, and nothing is taken."""
        if self.z is None and size > len(self.buffer) + self.raw.size - self.at:
            return None
        while len(self.buffer) < size + 64 and self.more():
            pass
        after = bytes(self.buffer[size : size + 64]).lstrip(b"\r\n")
        if len(self.buffer) < size or after and not after.startswith(b"WARC/"[: len(after)]):
            return None
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        return out


def streams(f) -> Iterator[Stream | None]:
    """The members of a file one after the other (read each to its end), or the plain file; None for bytes that are no member.

    After a damaged member, or such bytes, reading goes on at the next member that begins with a record. Zeros between members are padding.
    """
    raw, at = Raw(f), 0
    packed = raw.piece(0).startswith(b"\x1f\x8b")
    if not packed and raw.size:
        yield Stream(raw, 0, False)
        return
    while data := raw.piece(at):
        if (zeros := len(data) - len(data.lstrip(b"\0"))) > 0:
            at += zeros
            continue
        if data.startswith(b"\x1f\x8b"):
            stream = Stream(raw, at, True)
            yield stream
            if not stream.broken:
                at = stream.at
                continue
            at += 1
        else:
            yield None
        at = next_member(raw, at)


def next_member(raw: Raw, at: int) -> int:
    """Where the next member starts that begins with a record; the file's size if none does."""
    while data := raw.piece(at):
        found = data.find(b"\x1f\x8b\x08")
        if found < 0:
            at += max(1, len(data) - 2)
            continue
        at += found
        probe = Stream(raw, at, True)
        while len(probe.buffer) < 5 and probe.more():
            pass
        if probe.buffer.startswith(b"WARC/"):
            return at
        at += 1
    return raw.size


def number(x: str | None) -> int | None:
    """A field's value, -1 if it is no whole number, None if the field is missing."""
    return None if x is None else int(x) if re.fullmatch("[0-9]{1,18}", x) else -1


def records(f) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(fields by lower-case name, block) of every record; the block is None where its length is missing, no number or not met.

    Of bytes that can't be read as a record, a damaged member's or others between members, there is one record of type "damaged".
    """
    for stream in streams(f):
        whole = False  # whether all that was read of this member so far added up
        while stream is not None and (line := stream.line()) is not None:
            if not line.startswith(b"WARC/"):
                continue
            fields = {}
            while (line := stream.line()) not in (None, b"\r\n", b"\n"):
                k, _, v = line.decode("utf-8", "replace").partition(":")
                fields[k.strip().lower()] = v.strip()
            size = number(fields.get("content-length"))
            block = stream.block(size) if size is not None and size >= 0 else None
            whole = block is not None or "warc-type" in fields and "warc-record-id" in fields
            yield fields, block
        if stream is None or (stream.broken and not whole):
            yield {"warc-type": DAMAGED}, None


PARSED = "origin string,segment int,total long,record_type string,refers_to string,url string,payload_digest string,payload_bytes long,block binary"
READ = "record_id string,record_type string,refers_to string,url string,payload_bytes long,payload_digest string,segments int,status string"


def payload_of(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP head")
    return dechunked(body) if CHUNKED.search(head) else body


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Response and revisit records of the manifest's files, put together again.

    One row a record: record_id, record_type, refers_to, url, payload_bytes and
    payload_digest (of the payload as read; of a revisit as its record states),
    segments, status ("ok" or "incomplete") and, unless left out, payload.
    """
    parsed, arrow = schema(PARSED), to_arrow_schema(schema(PARSED))
    out = schema(READ + (",payload binary" if with_payload else ""))
    out_arrow = to_arrow_schema(out)
    n = max(1, manifest.count())

    def whole(block: bytes, stated: str | None) -> list:
        try:
            payload = payload_of(block)
        except ValueError:
            return [None, None, "incomplete", None]
        digest = sha1_base32(payload)
        return [len(payload), digest, "ok" if stated in (None, digest) else "incomplete", payload]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                with open_input(uri) as f:
                    for h, block in records(f):
                        kind = h.get("warc-type")
                        if kind not in ("response", "revisit", "continuation", DAMAGED):
                            continue
                        strip = lambda x: x and x.strip("<>")
                        origin = strip(h.get("warc-segment-origin-id") or h.get("warc-record-id"))
                        segment, total, stated = (number(h.get(f"warc-{k}")) for k in ("segment-number", "segment-total-length", "payload-length"))
                        digest = h.get("warc-payload-digest", "").rpartition(":")[2] or None
                        if -1 in (segment, total, stated) or segment is not None and not 0 < segment < 1 << 31 or block is None or kind == "continuation" and segment is None or kind == DAMAGED:
                            stated, digest, segment, block = None, None, -1, None
                        elif kind == "response" and segment is None and not with_payload:  # nothing to gather: decode here, keep the row narrow
                            got = whole(block, digest)
                            stated, digest, segment, block = got[0], got[1], None if got[2] == "ok" else -1, None
                        rows.append((origin, segment, total, kind, strip(h.get("warc-refers-to")), h.get("warc-target-uri"), digest, stated, None if kind == "revisit" else block))
                        size += len(block or b"") + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(zip(*rows), arrow)], schema=arrow)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(zip(*rows), arrow)], schema=arrow)

    def finish(group: list[tuple]) -> list[list]:
        """Rows of one origin, ordered by segment."""
        singles = [r for r in group if r[1] is None or r[1] < 0]
        made = []
        for r in singles:
            if r[8] is None:
                got = [r[7], r[6], "ok" if r[1] is None else "incomplete", None]
            else:
                got = whole(r[8], r[6])
            made.append([r[0], r[3], r[4], r[5], got[0], got[1], 1, got[2], got[3]])
        parts = [r for r in group if r[1] is not None and r[1] > 0]
        if parts:
            by: dict[int, list[tuple]] = {}
            for r in parts:
                by.setdefault(r[1], []).append(r)
            first, totals = by.get(1, [parts[0]])[0], {r[2] for r in parts if r[2] is not None}
            for turn in range(len(by.get(1, [None]))):  # a record written twice is read twice
                chain = [by[k][min(turn, len(by[k]) - 1)] for k in sorted(by)]
                block = b"".join(r[8] for r in chain)
                good = sorted(by) == list(range(1, len(by) + 1)) and totals == {len(block)}
                got = whole(block, first[6]) if good else [None, None, "incomplete", None]
                made.append([first[0], first[3], first[4], first[5], got[0], got[1], len(chain), got[2], got[3]])
        return made

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        rows: list[list] = []
        size = 0
        width = len(out_arrow)

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(zip(*(r[:width] for r in rows)), out_arrow)], schema=out_arrow)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(len(arrow)))):
                if group and group[0][0] != row[0]:
                    made = finish(group)
                    rows += made
                    size += sum(200 + (len(r[8] or b"") if with_payload else 0) for r in made)
                    group = []
                if size > 8 << 20:
                    yield packed()
                    rows, size = [], 0
                if row[1] is None or row[1] < 0:
                    rows += (made := finish([row]))
                    size += 200 + (len(made[0][8] or b"") if with_payload else 0)
                else:
                    group.append(row)
        if group:
            rows += finish(group)
        if rows:
            yield packed()

    found = map_arrow(manifest.select("file").repartition(n), parse, parsed)
    return map_arrow(found.repartition("origin").sortWithinPartitions("origin", "segment"), gather, out)


def page_results(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archives that ``write_warc`` wrote."""
    number = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) AS bigint)")  # noqa: E731  of "urn:page:<id>:<hash>"
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "segments", "status")
