"""WARC round trips, segment reassembly and broken archives."""

import base64
import hashlib

import pytest

from speechframe.llm import warc
from speechframe.llm.common import open_output, shared_dir


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows):
    out = []
    for i, h in rows:
        b = (h or "").encode()
        same = [k for k, x in rows if (x or "").encode() == b and k is not None]
        top = max(same, default=None)
        revisit = top is not None and (i is None or i < top)
        out.append((i, len(b), digest(b), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [
    [], [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b\r\n\r\nWARC/1.1\r\n")], [(1, "é" * 50_000), (2, "x" * 200_000), (3, "é" * 50_000)], [(7, "same"), (7, "same"), (8, "y"), (None, "same"), (None, "z")]])
def test_round_trip(spark, rows):
    df = spark.createDataFrame([(i, f"http://e/{i}", h, "extra", b"p") for i, h in rows], "page_id long, url string, html string, segment string, payload binary")
    read = warc.read_warc(warc.write_warc(df, shared_dir(spark, "t"), segment_bytes=8192))
    got = [tuple(r) for r in warc.page_results(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == brute(rows)
    whole = {r.url: r.payload for r in read.where("record_type = 'response'").collect()}
    assert all(bytes(whole[f"http://e/{i}"]) == (h or "").encode() for i, h in rows if f"http://e/{i}" in whole and [x for x, _ in rows].count(i) == 1)
    assert read.where("status <> 'ok'").count() == 0


def test_chunked():
    for n in (0, 1, 8191, 8192, 8193, 30_000):
        assert warc.dechunked(warc.chunked(b"x" * n)) == b"x" * n
    assert warc.dechunked(b"A ; x=1\r\n0123456789\r\n0\r\n\r\n") == b"0123456789"
    for bad in (b"5\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"", b"1\r\na\r\n-6\r\n", b"5_0\r\n" + b"x" * 80 + b"\r\n0\r\n\r\n", b"0x1\r\na\r\n0\r\n\r\n", b"+1\r\na\r\n0\r\n\r\n", b"\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def archive(spark, records):
    """Records dealt over two files, in the order given."""
    out = shared_dir(spark, "t")
    for k in (0, 1):
        with open_output(f"{out}/{k}.warc.gz") as f:
            for r in records[k::2]:
                f.write(warc.zlib_member(r))
    return spark.createDataFrame([(f"{out}/0.warc.gz", 1), (f"{out}/1.warc.gz", 1)], "file string, records long")


def test_segments_in_any_order_and_file(spark):
    parts = list(warc.page_records("1:a", "u", b"q" * 40_000, None, 8192))
    assert len(parts) > 3
    r = warc.read_warc(archive(spark, parts[::-1])).collect()
    assert len(r) == 1 and r[0].status == "ok" and bytes(r[0].payload) == b"q" * 40_000 and r[0].segments == len(parts)


@pytest.mark.parametrize("lost", [0, 1, -1])
def test_a_lost_segment_is_told(spark, lost):
    parts = list(warc.page_records("1:a", "u", b"q" * 40_000, None, 8192))
    del parts[lost]
    r = warc.read_warc(archive(spark, parts)).collect()
    assert [x.status for x in r] == ["incomplete"] and r[0].payload is None


@pytest.mark.parametrize("with_payload", [True, False])
def test_numbers_that_are_none(spark, with_payload):
    made = []
    for field in ("Content-Length", "WARC-Payload-Length", "WARC-Segment-Number", "WARC-Segment-Total-Length"):
        for value in ("abc", "-5", "1_0", "", "9" * 30):
            one = list(warc.page_records(f"{len(made)}:b", f"u{len(made)}", b"q" * 300, None, 8192))[0]
            head, _, rest = one.partition(b"\r\n\r\n")
            lines = [x for x in head.split(b"\r\n") if not x.lower().startswith(field.lower().encode() + b":")]
            made.append(b"\r\n".join([*lines, f"{field}: {value}".encode()]) + b"\r\n\r\n" + rest)
    good = list(warc.page_records("x:a", "good", b"q" * 300, None, 8192))
    r = {x.url: (x.status, x.payload_bytes) for x in warc.read_warc(archive(spark, [y for m in made for y in (m, m.replace(b":b>", b":c>").replace(b"URI: u", b"URI: v"))] + good), with_payload).collect()}
    assert r.pop("good") == ("ok", 300) and len(r) == 2 * len(made) and set(r.values()) == {("incomplete", None)}


def test_a_cut_file_is_told(spark):
    whole = list(warc.page_records("1:a", "u", b"q" * 300, None, 8192))[0]
    assert [x.status for x in warc.read_warc(archive(spark, [whole[:-50]]), False).collect()] == ["incomplete"]


@pytest.mark.parametrize("spelling", [b"Transfer-Encoding: chunked", b"transfer-encoding:chunked", b"TRANSFER-ENCODING:  gzip, Chunked "])
def test_spellings_of_the_framing(spelling):
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n" + spelling + b"\r\nX: y\r\n\r\n" + warc.chunked(b"abc")) == b"abc"


def test_a_payload_of_a_third_of_all_pages(spark, monkeypatch):
    from speechframe.llm import common

    monkeypatch.setattr(common, "PART_ROWS", 7)
    rows = [(i, "same" if i % 3 else f"p{i}") for i in range(150)]
    df = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string")
    read = warc.read_warc(warc.write_warc(df, shared_dir(spark, "t")), False)
    got = [tuple(r) for r in warc.page_results(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == brute(rows)


def one(k, payload=b"q" * 300):
    return list(warc.page_records(f"{k}:a", f"u{k}", payload, None, 1 << 20))[0]


def read_bytes(spark, data, name="x.warc.gz"):
    uri = f"{shared_dir(spark, 't')}/{name}"
    with open_output(uri) as f:
        f.write(data)
    return sorted(((r.url, r.status, r.record_type) for r in warc.read_warc(spark.createDataFrame([(uri, 1)], "file string, records long"), False).collect()), key=repr)


GOOD = "ok", "response"


@pytest.mark.parametrize("length", [600, 301, 299, 0, 999_999, 10**17])
@pytest.mark.parametrize("packed", [True, False])
def test_a_length_that_isnt_met_takes_no_other_record(spark, length, packed):
    records = [one(k) for k in range(4)]
    head, _, rest = records[1].partition(b"\r\n\r\n")
    head = head[: head.rindex(b"Content-Length")] + b"Content-Length: %d" % length
    records[1] = head + b"\r\n\r\n" + rest
    data = b"".join(map(warc.zlib_member, records)) if packed else b"".join(records)
    assert read_bytes(spark, data) == sorted([("u0", *GOOD), ("u1", "incomplete", "response"), ("u2", *GOOD), ("u3", *GOOD)], key=repr)


def test_several_records_in_a_member(spark):
    records = [one(k) for k in range(4)]
    records[1] = records[1].replace(b"Content-Length: ", b"Content-Length: 9")
    assert read_bytes(spark, warc.zlib_member(b"".join(records))) == sorted([("u0", *GOOD), ("u1", "incomplete", "response"), ("u2", *GOOD), ("u3", *GOOD)], key=repr)


@pytest.mark.parametrize("between,damaged", [(b"\0" * 10, 0), (b"\0" * 100_000, 0), (b"junk", 1), (b"\x1f\x8b\x08\0broken", 1), (b"\x1f\x8b", 1)])
@pytest.mark.parametrize("last", [True, False])
def test_bytes_between_and_after_members(spark, between, damaged, last):
    members = [warc.zlib_member(one(k)) for k in range(3)]
    data = b"".join(members) + between if last else members[0] + between + b"".join(members[1:])
    assert read_bytes(spark, data) == sorted([*((f"u{k}", *GOOD) for k in range(3)), *[(None, "incomplete", "damaged")] * damaged], key=repr)


def test_broken_members(spark):
    """Any one member with bytes overwritten, cut out or cut off: every other record comes back, and something tells of the broken one."""
    import random

    r = random.Random(5)
    payloads = [bytes(r.randrange(256) for _ in range(3000)) for _ in range(5)]
    members = [warc.zlib_member(one(k, p)) for k, p in enumerate(payloads)]
    for trial in range(12):
        k, at = r.randrange(5), r.randrange(20, len(members[0]) - 60)
        bad = [members[k][:at] + b"\xff" * 30 + members[k][at + 30 :], members[k][:at] + members[k][at + 40 :], members[k][:at]][trial % 3]
        got = read_bytes(spark, b"".join([*members[:k], bad, *members[k + 1 :]]))
        assert [x for x in got if x[1] == "ok"] == [(f"u{j}", *GOOD) for j in range(5) if j != k], (k, at)
        assert len(got) > 4
