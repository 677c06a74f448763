"""Queues of a stream against a plain loop, with rows dealt to batches out of order and a restart between them."""

import random

import pytest
from test_streams import Runs, minute

from speechframe.streaming import queues

ROWS = "key long, ts timestamp, ord long, take boolean, priority int"


def plain(rows, last, most, drop, patience):
    """Rows before the last time, key by key, with a list for a queue."""
    out = []
    for key in {r[0] for r in rows}:
        items, dropped, expired = [], 0, 0
        for _, ts, ord_, take, priority in sorted((r for r in rows if r[0] == key and r[1] < last), key=lambda r: (r[1], r[2])):
            if patience is not None:
                late = [x for x in items if (ts - x[1]).total_seconds() > patience]
                expired += len(late)
                items = [x for x in items if x not in late]
            if take:
                best = min(items, default=None)
                if best:
                    items.remove(best)
                out.append((key, ord_, best and best[2], best and (ts - best[1]).total_seconds(), dropped, expired))
                continue
            if most is not None and len(items) == most:
                dropped += 1
                if drop == "newest":
                    continue
                items.remove(min(items, key=lambda x: x[1:]))
            items.append((priority or 0, ts, ord_))
    return sorted(out, key=str)


RULES = [(3, "newest", None), (3, "oldest", None), (None, "newest", 600.0), (2, "oldest", 1200.0)]


@pytest.mark.parametrize("most,drop,patience", RULES)
def test_like_a_loop_across_a_restart(spark, tmp_path, most, drop, patience):
    r = random.Random(5)
    rows = [(r.randrange(4), minute(k // 2), k, r.random() < 0.3, r.choice([0, 1, 1, None])) for k in range(160)]  # two rows a minute: ties
    want = plain(rows, minute(79), most, drop, patience)
    assert any(w[2] is None for w in want) or most is None and patience is None
    assert sum(w[4] + w[5] for w in want) > 0
    run, got = Runs(spark, tmp_path, ROWS, lambda s: queues.served(s, most, drop, patience)), []
    for p in (rows[:70], rows[70:]):
        got += run(r.sample(p, len(p)))
    assert sorted(got, key=str) == want


@pytest.mark.parametrize("most,drop,patience", RULES)
def test_keys_share_groups_of_state(spark, tmp_path, most, drop, patience):
    r = random.Random(8)
    rows = [(r.randrange(60), minute(k // 20), (1 << 53) + k, r.random() < 0.3, r.choice([0, 1, 1, None])) for k in range(1200)]
    run = Runs(spark, tmp_path, ROWS, lambda s: queues.served(s, most, drop, patience, buckets=4))
    got = [x for p in (rows[:500], rows[500:]) for x in run(r.sample(p, len(p)))]
    assert sorted(got, key=str) == plain(rows, minute(59), most, drop, patience)
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "items").load(f"{tmp_path}/state")
    assert 1 <= state.count() <= 4


def test_odd_rows(spark, tmp_path):
    run = Runs(spark, tmp_path, ROWS, lambda s: queues.served(s, most=2))
    assert run([]) == []
    # Rows without key, time or number are left out; a null take puts, a null priority is the highest.
    assert run([(None, minute(0), 1, False, 0), (1, None, 2, False, 0), (1, minute(0), None, False, 0), (1, minute(1), 3, False, 1), (1, minute(2), 4, None, None), (1, minute(3), 5, True, 0)]) == []
    # The same row twice is two items; nothing more of key 1 is needed.
    assert run([(2, minute(9), 6, False, 0), (2, minute(9), 6, False, 0), (2, minute(9), 7, False, 0), (2, minute(10), 8, True, 0), (2, minute(11), 9, True, 0), (2, minute(12), 10, True, 0)]) == [(1, 5, 4, 60.0, 0, 0), (2, 8, 6, 60.0, 1, 0), (2, 9, 6, 120.0, 1, 0)]
    assert run([(3, minute(60), 11, False, 0)]) == [(2, 10, None, None, 1, 0)]


def test_bounds_are_checked(spark):
    rows = spark.createDataFrame([], ROWS)
    for wrong in ({"most": 0}, {"drop": "some"}, {"patience": -1.0}):
        with pytest.raises(ValueError):
            queues.served(rows, **wrong)
