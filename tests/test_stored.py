"""Recordings by byte range and as they grow, files at job commit, rotated logs, stores that rewrite what they touch."""

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechframe.operators.store import KeyedStore
from speechframe.sources import binary, files
from speechframe.streaming.operators import drain


def wav(samples, note=b""):
    extra = struct.pack("<4sI", b"note", len(note)) + note if note else b""
    return struct.pack("<4sI4s4sIHHIIHH", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 1, 16000, 32000, 2, 16) + extra + struct.pack("<4sI", b"data", 2 * len(samples)) + np.asarray(samples, "<i2").tobytes()


def plain(samples, frame, whole=False):
    x = np.asarray(samples, "<i2").astype(np.float32) / 32768.0
    cut = [x[k : k + frame] for k in range(0, len(x), frame)]
    return [(i, pytest.approx(float(np.sqrt(np.mean(v.astype(float) ** 2)))), pytest.approx(float(np.max(np.abs(v))))) for i, v in enumerate(cut) if len(v) == frame or not whole]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(os.path.basename(r.path), []).append((r.frame_no, r.rms, r.peak))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("split", [80, 1000, 1 << 20])
def test_recordings_by_byte_range(spark, tmp_path, split):
    r = random.Random(1)
    data = {f"{n}.wav": [r.randrange(-32768, 32768) for _ in range(n)] for n in (1, 9, 10, 11, 500, 2003)}
    for name, x in data.items():
        (tmp_path / name).write_bytes(wav(x, b"n" * (len(x) % 7 * 100)))
    (tmp_path / "none.wav").write_bytes(b"")
    (tmp_path / "head.wav").write_bytes(wav([]))
    (tmp_path / ".hidden.wav").write_bytes(wav([1] * 50))
    df = binary.recorded_frames(spark, f"file://{tmp_path}", frame=10, split_bytes=split)
    assert found(df) == {k: plain(x, 10) for k, x in data.items()}
    assert df.rdd.getNumPartitions() >= (60 if split == 80 else 8)


def test_no_recordings(spark, tmp_path):
    assert binary.recorded_frames(spark, f"file://{tmp_path}/none").count() == 0


def test_many_small_recordings_share_tasks(spark, tmp_path):
    r = random.Random(3)
    data = {f"{n}.wav": [r.randrange(-32768, 32768) for _ in range(n % 40 + 1)] for n in range(1500)}
    for name, x in data.items():
        (tmp_path / name).write_bytes(wav(x))
    df = binary.recorded_frames(spark, f"file://{tmp_path}", frame=10, split_bytes=80)
    assert df.rdd.getNumPartitions() <= 2 * binary.TASKS
    assert found(df) == {k: plain(x, 10) for k, x in data.items()}


def test_growing_recordings(spark, tmp_path):
    """Appended to at any byte, the head included; every whole frame comes once, in whichever run it was completed."""
    r = random.Random(2)
    whole = {f"{k}.wav": wav([r.randrange(-32768, 32768) for _ in range(n)], b"x" * k) for k, n in enumerate((5, 64, 333, 1000))}
    (tmp_path / "in").mkdir()
    got, size = [], dict.fromkeys(whole, 0)
    for _ in range(5):
        for name, b in whole.items():
            size[name] = len(b) if _ == 4 else min(len(b), size[name] + r.choice([0, 1, 30, 77, 500]))
            (tmp_path / "in" / name).write_bytes(b[: size[name]])
        drain(binary.growing_frames(spark, f"file://{tmp_path}/in", frame=8, split_bytes=64), lambda b, i: got.append(b.collect()), f"{tmp_path}/state")
    out = {}
    for batch in got:
        for x in batch:
            out.setdefault(os.path.basename(x.path), []).append((x.frame_no, x.rms, x.peak))
    assert {k: sorted(v) for k, v in out.items()} == {k: v for k, b in whole.items() if (v := plain(np.frombuffer(b[b.index(b"data") + 8 :], "<i2"), 8, True))}


def test_many_small_recordings_that_grow_share_tasks(tmp_path):
    for n in range(1500):
        (tmp_path / f"{n}.wav").write_bytes(wav([n] * 20))
    reader = binary.PcmStreamReader(binary.Options({"path": f"file://{tmp_path}", "frame": "8"}))
    end = reader.latestOffset()
    assert set(end) == {f"{n}.wav" for n in range(1500)}
    tasks = reader.partitions({}, end)
    assert len(tasks) <= 2 * binary.TASKS
    assert sum(b.num_rows for t in tasks for b in reader.read(t)) == 3000
    by_uri = {f"file://{tmp_path}/{k}": v for k, v in end.items()}
    assert reader.partitions(by_uri, end) == []
    assert sum(b.num_rows for t in reader.partitions({k: 60 for k in end}, end) for b in reader.read(t)) == 1500


def test_files_appear_at_commit_or_not_at_all(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    make = lambda n, k: spark.range(n, numPartitions=4).select(F.concat(F.col("id").cast("string"), F.lit(".bin")).alias("name"), F.repeat(F.lit(k), 10).cast("binary").alias("content"))
    binary.write_files(make(20, "a"), out)
    fails = F.when(F.col("name") == "19.bin", F.raise_error(F.lit("task fails"))).otherwise(F.col("content"))
    with pytest.raises(Exception, match="task fails"):
        binary.write_files(make(20, "b").withColumn("content", fails), out)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"{k}.bin": b"a" * 10 for k in range(20)}
    binary.write_files(make(3, "c"), out)
    assert {p.name: p.read_bytes()[:1] for p in (tmp_path / "out").iterdir()} == {f"{k}.bin": b"c" if k < 3 else b"a" for k in range(20)}


@pytest.mark.parametrize("n,limit", [(0, 50), (1, 50), (200, 50), (200, 1000), (200, 10**6)])
def test_rotated_logs(spark, n, limit):
    r = random.Random(n)
    lines = [(k // 3, k, "é" * r.randrange(30) if k % 7 else None) for k in range(n)]
    size = lambda x: len((x or "").encode()) + 1
    want, at = [], 0
    for _, k, x in lines:
        want.append((k, at // limit))
        at += size(x)
    last = want[-1][1] if want else 0
    got = files.rotated(spark.createDataFrame(lines, "ts long, id long, line string").repartition(5), ["ts", "id"], "line", limit)
    assert sorted((x.id, x.age) for x in got.collect()) == [(k, last - g) for k, g in want if last - g < 2]


KIND = "k string, day long, n long, note string"
RULES = {"n": "greatest", "note": "sticky"}


def test_stores_rewrite_what_they_touch(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    store = KeyedStore(spark, f"file://{tmp_path}/t", frame([]).schema, ["k", "day"], buckets=8)
    assert store.read().count() == 0
    first = [(f"k{i}", i % 3, i, f"n{i}") for i in range(100)]
    assert store.upsert(frame(first), RULES) == list(range(8))
    before = store.current()["generations"]
    assert len(store.upsert(frame([("k7", 1, 3, "new"), ("k7", 5, 8, None)]), RULES, batch=4)) <= 2
    after = store.current()["generations"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert 0 < len(changed) <= 2
    want = {(k, d): (n, t) for k, d, n, t in first} | {("k7", 1): (7, "new"), ("k7", 5): (8, None)}
    assert {(r.k, r.day): (r.n, r.note) for r in store.read().collect()} == want
    # A batch that comes again, an empty one, and one that fails leave it as it is.
    assert store.upsert(frame([("k7", 1, 99, "x")]), RULES, batch=4) == [] == store.upsert(frame([]), RULES)
    with pytest.raises(Exception, match="bad row"):
        store.upsert(frame([("k8", 2, 99, "x")]).withColumn("n", F.raise_error(F.lit("bad row")).cast("long")), RULES)
    assert {(r.k, r.day): (r.n, r.note) for r in KeyedStore(spark, f"file://{tmp_path}/t", frame([]).schema, ["k", "day"], 8).read().collect()} == want
