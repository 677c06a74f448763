"""Queues as state of a stream: bounded ones that drop the newest or the oldest, and jobs served by priority.

A row either puts an item into its key's queue or takes the next one out.  Rows count
in the order of (ts, ord) however they arrive: what the watermark hasn't passed
waits in list state.  A queue lives in the checkpoint, so a stream that starts
again serves what was waiting before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .operators import BUCKETS

#: State as packed rows: a call for each row would cost more than the work.
ROW = np.dtype([("key", "<i8"), ("ts", "<i8"), ("ord", "<i8"), ("priority", "<i4"), ("take", "?")])
ITEM = np.dtype([("key", "<i8"), ("priority", "<i4"), ("ts", "<i8"), ("ord", "<i8")])
LOST = np.dtype([("key", "<i8"), ("dropped", "<i8"), ("expired", "<i8")])
DROPS = ("newest", "oldest")


class Queue(StatefulProcessor):
    """State of a bucket of keys: rows ahead of the watermark, the items that wait (those of a key's lowest priority value, then the earliest, are served first), and how many of each key were dropped and given up."""

    def __init__(self, most: int | None, drop: str, patience_us: int | None):
        self.most, self.drop, self.patience = most, drop, patience_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "rows binary")
        self.items = handle.getValueState("items", "rows binary")
        self.lost = handle.getValueState("lost", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            new = np.empty(len(batch), ROW)
            for name, c in zip(ROW.names, ("key", "ts_us", "ord", "priority", "take")):
                new[name] = batch[c].to_numpy()
            self.ahead.appendValue((new.tobytes(),))
            first = min([int(new["ts"].min())] + ([] if first is None else [first]))
        if first is not None:
            self.wake(first, timerValues)
        yield from ()

    def wake(self, us: int, timerValues) -> None:
        """Comes back once the watermark is past a time."""
        self.handle.registerTimer(max(us // 1000, timerValues.getCurrentWatermarkInMs()) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = np.frombuffer(b"".join(x for x, in self.ahead.get()), ROW)
        ready, left = rows[rows["ts"] < passed], rows[rows["ts"] >= passed]
        if len(ready):
            out = self.serve(ready[np.lexsort([ready[c] for c in ("take", "priority", "ord", "ts", "key")])])
            if len(left):
                self.ahead.put([(left.tobytes(),)])
            else:
                self.ahead.clear()
            if out:
                columns = dict(zip(("key", "ord", "item", "waited", "dropped", "expired"), zip(*out)))
                yield pd.DataFrame(columns | {"item": pd.array(columns["item"], dtype="Int64"), "waited": np.array(columns["waited"], "float64")})
        if len(left):
            self.wake(int(left["ts"].min()), timerValues)

    def serve(self, ready: np.ndarray) -> list[tuple]:
        """What takers get, of rows in the order of keys and times."""
        waiting: dict[int, list[tuple]] = {}
        for k, *x in self.packed(self.items, ITEM):
            waiting.setdefault(k, []).append(tuple(x))
        lost = {k: (d, e) for k, d, e in self.packed(self.lost, LOST)}
        out, of, items, dropped, expired = [], None, [], 0, 0
        for k, ts, ord_, priority, take in ready.tolist():
            if k != of:
                of, items, (dropped, expired) = k, waiting.setdefault(k, []), lost.get(k, (0, 0))
            if self.patience is not None:
                given_up = [x for x in items if ts - x[1] > self.patience]
                if given_up:
                    expired += len(given_up)
                    items[:] = [x for x in items if ts - x[1] <= self.patience]
            if take:
                item = min(items, default=None)
                if item is not None:
                    items.remove(item)
                out.append((k, ord_, item and item[2], item and (ts - item[1]) / 1e6, dropped, expired))
            elif self.most is None or len(items) < self.most:
                items.append((priority, ts, ord_))
            else:
                dropped += 1
                if self.drop == "oldest":
                    items.remove(min(items, key=lambda x: x[1:]))
                    items.append((priority, ts, ord_))
            if dropped or expired:
                lost[k] = dropped, expired
        for state, kept in ((self.items, np.array([(k, *x) for k, xs in waiting.items() for x in xs], ITEM)), (self.lost, np.array([(k, *n) for k, n in lost.items()], LOST))):
            if len(kept):
                state.update((kept.tobytes(),))
            else:
                state.clear()
        return out

    @staticmethod
    def packed(state, of: np.dtype) -> list[tuple]:
        return np.frombuffer(state.get()[0], of).tolist() if state.exists() else []


def served(rows: DataFrame, most: int | None = None, drop: str = "newest", patience: float | None = None, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """What the takers of ``rows`` (key long, ts, ord, take boolean, priority) get: (key, ord of the taker, ord of its item, seconds waited, dropped and expired so far).

    A queue holds at most ``most`` items; one more drops the newcomer or the oldest.
    Items that wait longer than ``patience`` seconds are given up before the next row, so
    that with either bound a key's state stays small.  A taker that finds nothing gets nulls. A null
    priority counts as 0, a null take as false; rows without key, ts or ord are left out.
    A row at the watermark of ts (``late`` behind the latest row) waits for more. Keys are dealt to ``buckets`` groups of state by a hash, as a
    call of Python costs milliseconds, however few rows it gets; a batch reads and writes the buckets of its keys whole.
    """
    if drop not in DROPS:
        raise ValueError(f"drop must be one of {DROPS}")
    if most is not None and most < 1 or patience is not None and patience < 0:
        raise ValueError("a queue holds at least one item, and patience isn't negative")
    given = rows.where("key is not null and ts is not null and ord is not null").select(
        "ts", F.col("key").cast("long").alias("key"), F.col("ord").cast("long").alias("ord"), F.coalesce(F.col("priority").cast("int"), F.lit(0)).alias("priority"),
        F.coalesce("take", F.lit(False)).alias("take"), F.unix_micros("ts").alias("ts_us"))
    queue = Queue(most, drop, None if patience is None else round(patience * 1e6))
    dealt = given.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(queue, "key long, ord long, item long, waited double, dropped long, expired long", "append", "EventTime")
