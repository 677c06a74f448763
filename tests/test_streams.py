"""State and timers: reminders across restarts, suppression with a time to live, windows of growing recordings."""

import random
from datetime import datetime, timedelta

import pytest

from speechframe.operators import folds
from speechframe.streaming import operators as ops
from speechframe.streaming import stateful

START = datetime(2024, 1, 1)
TASKS = "task_id long, status string, due timestamp, ts timestamp, ord long"


def minute(m):
    return START + timedelta(minutes=m)


class Runs:
    """A stream over a folder that gets more files between runs of it, each a new start from the checkpoint."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.folder, self.schema, self.make = spark, str(folder), schema, make

    def __call__(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        out = []
        with stateful.timers(self.spark):
            s = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in")
            ops.drain(self.make(s), lambda b, i: out.extend(map(tuple, b.collect())), f"{self.folder}/state")
        return sorted(out)


def due(task, m):
    return task, minute(m).timestamp()


def test_reminders_fire_once_across_restarts(spark, tmp_path):
    run = Runs(spark, tmp_path, TASKS, stateful.due_reminders)
    assert run([(1, "open", minute(10), minute(0), 0), (2, "open", minute(10), minute(0), 1), (2, "done", None, minute(5), 2), (3, "open", minute(50), minute(0), 3), (4, "open", None, minute(1), 4)]) == []
    # No further row of task 1; another task's row moves the watermark.
    assert run([(9, "open", None, minute(20), 5)]) == [due(1, 10)]
    assert run([(9, "open", None, minute(21), 6), (5, "open", minute(30), minute(21), 7)]) == []
    # Put off, closed too late, opened again after firing.
    assert run([(5, "open", minute(45), minute(29), 8), (3, "done", None, minute(50), 9), (1, "open", minute(40), minute(35), 10), (9, "open", None, minute(49), 11)]) == [due(5, 45)]
    assert run([(9, "open", None, minute(70), 12)]) == [due(3, 50)]
    assert run([(9, "open", None, minute(90), 13)]) == []


def plain_reminders(rows, now):
    out = []
    for task in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == task and r[3] < now), key=lambda r: (r[3], r[4]))
        status, due_at, at = None, None, START
        for r in [*mine, None]:
            until = r[3] if r else now - timedelta(microseconds=1)
            if status == "open" and due_at is not None and max(due_at, at) <= until:
                out.append((task, due_at.timestamp()))
                break
            if r:
                status, due_at, at = r[1], r[2] or due_at, r[3]
    return sorted(out)


def test_reminders_like_a_loop_however_rows_are_dealt(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randrange(12), r.choice(["open", "open", "done"]), minute(r.randrange(200)) if r.random() < 0.6 else None, minute(k), k) for k in range(120)]
    want = plain_reminders(rows, minute(119))
    assert len(want) > 3
    for n, parts in enumerate(([rows], [rows[:40], rows[40:60], rows[60:]])):
        run = Runs(spark, tmp_path / str(n), TASKS, stateful.due_reminders)
        got = []
        for p in parts:
            got += run(r.sample(p, len(p)))
        assert sorted(got) == want


EVENTS = "k long, v string, ts timestamp, event_id long"


def plain_suppressed(rows, seconds):
    last, out = {}, []
    for k, v, t, e in sorted(rows, key=lambda x: (x[2], x[3])):
        if (k, v) not in last or t - last[k, v] >= timedelta(seconds=seconds):
            out.append((k, v, t, e))
            last[k, v] = t
    return sorted(out)


def test_suppression_like_a_loop_and_state_ends(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.randrange(3), r.choice("ab"), START + timedelta(seconds=r.randrange(600), microseconds=r.randrange(3)), k) for k in range(300)]
    rows = sorted(rows, key=lambda x: x[2])
    run = Runs(spark, tmp_path, EVENTS, lambda s: ops.suppress_repeats(s, "k", "v", "ts", 10.0, "0 seconds"))
    got = [x for part in (rows[:100], rows[100:101], rows[101:]) for x in run(part)]
    assert sorted(got) == plain_suppressed(rows, 10)
    run([(0, "z", START + timedelta(hours=1), 1000)])
    state = spark.read.format("statestore").option("operatorId", 0).load(f"{tmp_path}/state")
    assert state.count() <= 1  # of the six keys before, none is kept an hour later


def test_suppressed_keys_share_groups(spark, tmp_path):
    """Hundreds of keys, null ones too, in four groups of state, across a restart."""
    r = random.Random(6)
    rows = [(r.choice([None, *range(200)]), r.choice(["a", "b", None]), START + timedelta(seconds=k // 20, microseconds=r.randrange(3)), (1 << 53) + k) for k in range(2000)]
    run = Runs(spark, tmp_path, EVENTS, lambda s: ops.suppress_repeats(s, "k", "v", "ts", 10.0, "0 seconds", buckets=4).selectExpr("string(k)", "v", "ts", "event_id").fillna("None"))
    named = lambda x: (str(x[0]), str(x[1]), *x[2:])
    out = run(rows[:900]) + run(rows[900:])
    assert sorted(out) == plain_suppressed(list(map(named, rows)), 10)
    state = spark.read.format("statestore").option("operatorId", 0).load(f"{tmp_path}/state")
    assert 1 <= state.count() <= 4


LEVELS = "m long, frame long, rms double"


@pytest.mark.parametrize("make,whole", [
    (lambda: stateful.WindowCutter(), folds.window_cuts),
    (lambda: stateful.TailCutter(target=3.0), lambda x: [(c, c) for c in folds.tail_cuts(x, target=3.0)]),
])
def test_any_split_gives_the_windows_of_the_whole(make, whole):
    import numpy as np

    r = random.Random(7)
    for _ in range(60):
        level = np.array([r.choice([0.001, 0.5, 0.5, 0.5]) if r.random() < 0.3 else 0.5 for _ in range(r.choice([0, 5, 249, 250, 251, 400, 401, 900, 2000]))])
        cutter, at, got = make(), 0, []
        while at < len(level):
            n = r.choice([1, 7, 100, 1000])
            got += cutter.feed(level[at : at + n].tolist())
            at += n
        assert got + cutter.close() == whole(level)


def test_windows_as_recordings_grow(spark, tmp_path):
    """Frames late, early and twice; the rest comes with the end, and nothing is kept."""
    import numpy as np

    r = random.Random(9)
    levels = {m: [r.choice([0.001, 0.5, 0.5]) for _ in range(n)] for m, n in ((1, 700), (2, 90), (3, 0), (4, 1300))}
    rows = [(m, i, x) for m, v in levels.items() for i, x in enumerate(v)] + [(m, len(v), None) for m, v in levels.items()]
    run = Runs(spark, tmp_path, LEVELS, lambda s: stateful.cut_stream(s, stateful.WindowCutter))
    r.shuffle(rows)
    got = [x for part in (rows[:600], rows[600:1500], rows[1500:]) for x in run(part + part[:5])]
    assert sorted(got) == sorted((m, *w) for m, v in levels.items() for w in folds.window_cuts(np.array(v)))


def test_live_queries_are_those_of_the_batch(spark):
    from compare import SF
    from speechframe.queries import QUERIES

    rows = lambda q: sorted(map(tuple, QUERIES[q](spark, SF).collect()))
    assert rows("x1_streamed_windows") == rows("x1_live_windows")
    assert rows("x3_streamed_cuts") == rows("x3_dictation_cuts")


def test_no_scratch_without_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from speechframe import storage

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://x:7077")
    with pytest.raises(ValueError, match="share"):
        storage.scratch(SimpleNamespace(conf=conf, sparkContext=context), "x")


def test_replay_changes_nothing(spark, tmp_path):
    from speechframe.operators.store import KeyedStore

    schema = "id long, n long"
    spark.createDataFrame([(1, 5), (2, 6)], schema).write.parquet(f"{tmp_path}/in")
    store = KeyedStore(spark, f"file://{tmp_path}/t", spark.createDataFrame([], schema).schema, ["id"], 4)
    ops.replayed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, {"n": "greatest"}, f"{tmp_path}/state")
    assert store.upsert(spark.createDataFrame([(1, 99)], schema), {"n": "replace"}, batch=0) == []
    assert sorted(map(tuple, store.read().collect())) == [(1, 5), (2, 6)]
