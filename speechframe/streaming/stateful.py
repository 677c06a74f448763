"""Operators with state and event-time timers of their own: reminders that fire, and windows cut while a recording grows.

Both read rows in the order of event time or frame number however they arrive:
what has come too early waits in list state.  State lives in the checkpoint, so
a stream that starts again goes on with its timers and tails as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers(spark: SparkSession):
    """Streams started inside have the state store that timers and list state need."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def frame_of(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


class Reminders(StatefulProcessor):
    """State of a task: its rows that the watermark hasn't reached, then (status, due, whether fired, time of the last row), times in microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, ord long, status string, due long")
        self.task = handle.getValueState("task", "status string, due long, fired boolean, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for batch in rows:
            new = [(int(t), int(o), s, None if pd.isna(u) else int(u)) for t, o, s, u in zip(batch["ts_us"], batch["ord"], batch["status"], batch["due_us"])]
            self.waiting.appendList(new)
            times |= {t for t, *_ in new}
        if times:  # rows wait for the watermark; the first of them wakes the task
            self.handle.registerTimer(self.after(min(times), timerValues))
        yield from ()

    def after(self, us: int, timerValues) -> int:
        """The first whole millisecond after a time, and after the watermark."""
        return max(us // 1000, timerValues.getCurrentWatermarkInMs()) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        status, due, fired, at = self.task.get() if self.task.exists() else (None, None, False, 0)
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] < now]
        out = []

        def fire(until: int) -> bool:
            if status == "open" and due is not None and not fired and max(due, at) <= until:
                out.append((key[0], due / 1e6))
                return True
            return fired

        for ts, _, new, new_due in ready:
            fired = fire(ts)
            status, due, at = new, due if new_due is None else new_due, ts
        fired = fire(now - 1)
        self.task.update((status, due, fired, at))
        if ready:
            left = rows[len(ready) :]
            self.waiting.put(left) if left else self.waiting.clear()
        wake = [r[0] for r in rows[len(ready) :]][:1] + ([due] if status == "open" and due is not None and not fired else [])
        if wake:
            self.handle.registerTimer(self.after(min(wake), timerValues))
        if out:
            yield frame_of(out, ["task_id", "due"])


def due_reminders(tasks: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Reminders (task_id, due in epoch seconds) of ``tasks`` (task_id long, status, due timestamp or null, ts, ord).

    A task's rows count in the order of (ts, ord): each gives its status and, unless
    null, its due time.  A task fires once, when the watermark of ts (``late`` behind the
    latest row of any task) has passed the due time and no row before that closed it; a row at
    the due time itself comes too late to close it.  No further row of the task is needed.
    """
    us = "ts, ord, task_id, status, unix_micros(ts) AS ts_us, unix_micros(due) AS due_us".split(", ")
    return tasks.selectExpr(*us).withWatermark("ts", late).groupBy("task_id").transformWithStateInPandas(Reminders(), "task_id long, due double", "append", "EventTime")


class WindowCutter:
    """Windows of a recording whose levels come piece by piece.

    From a window's start there are ``target`` frames to wait for; then the last quiet
    frame of the stretch searched ends the window, else a second more is waited for,
    and at ``most`` frames it ends by force.  ``levels`` are the frames from ``at`` on.
    """

    def __init__(self, step: float = 0.1, target: float = 25.0, most: float = 40.0, search: float = 8.0, quiet: float = 0.012, overlap: float = 1.0):
        self.target, self.most, self.search, self.overlap = (round(x / step) for x in (target, most, search, overlap))
        self.quiet, self.at, self.want, self.levels = quiet, 0, self.target, []

    def _cut(self, have: int) -> int | None:
        """Frames up to and with the last quiet one searched."""
        first = max(self.target // 2, have - self.search)
        return next((i + 1 for i in range(have - 1, first, -1) if self.levels[i] < self.quiet), None)

    def _end(self, size: int, keep: int) -> tuple[int, int]:
        window = (self.at, self.at + size)
        step = max(1, size - keep)
        self.at, self.levels, self.want = self.at + step, self.levels[step:], self.target
        return window

    def feed(self, levels: list[float]) -> list[tuple[int, int]]:
        self.levels += levels
        out = []
        while len(self.levels) >= self.want:
            cut = self._cut(self.want)
            if cut is not None:
                out.append(self._end(cut, self.overlap))
            elif self.want >= self.most:
                out.append(self._end(self.most, 0))
            else:
                self.want += 10
        return out

    def close(self) -> list[tuple[int, int]]:
        """What is left when nothing more comes."""
        out = []
        while len(self.levels) >= self.target:
            have = min(self.want, len(self.levels))
            cut = self._cut(have)
            if cut is not None:
                out.append(self._end(cut, self.overlap))
            elif have >= self.most:
                out.append(self._end(self.most, 0))
            elif have == len(self.levels):
                break
            else:
                self.want += 10
        if self.levels:
            out.append(self._end(len(self.levels), 0))
        return out


class TailCutter:
    """Cuts of a growing dictation: the middle of the first ``run`` quiet frames from ``target`` frames after the last cut on."""

    def __init__(self, step: float = 0.1, target: float = 24.0, run: int = 4, quiet: float = 0.012):
        self.target, self.run, self.quiet = round(target / step), run, quiet
        self.at, self.want, self.levels = 0, self.target, []  # frames seen, the first that counts, the quiet run so far

    def feed(self, levels: list[float]) -> list[tuple[int, int]]:
        out = []
        for x in levels:
            if self.at >= self.want:
                self.levels = [*self.levels, x] if x < self.quiet else []
                if len(self.levels) == self.run:
                    cut = self.at + 1 - self.run + self.run // 2
                    out.append((cut, cut))
                    self.want, self.levels = cut + self.target, []
            self.at += 1
        return out

    def close(self) -> list[tuple[int, int]]:
        return []


class Cuts(StatefulProcessor):
    """State of a recording: its cutter's cursor, the tail of levels that no window has ended, and frames that came before their turn."""

    def __init__(self, make):
        self.make = make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "at long, want long, next long, size long")
        self.tail = handle.getListState("tail", "level double")
        self.early = handle.getListState("early", "frame long, level double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cutter, upto, size = self.make(), 0, None
        if self.cursor.exists():
            cutter.at, cutter.want, upto, size = self.cursor.get()
            cutter.levels = [r[0] for r in self.tail.get()]
        early = {f: x for f, x in self.early.get()}
        for batch in rows:
            for frame, level in zip(batch["frame"], batch["rms"]):
                if pd.isna(level):  # the recording has so many frames
                    size = int(frame)
                elif frame >= upto:
                    early[int(frame)] = float(level)
        ready = []
        while upto in early:
            ready.append(early.pop(upto))
            upto += 1
        out = cutter.feed(ready)
        if size is not None and upto >= size:
            out += cutter.close()
            for s in (self.cursor, self.tail, self.early):
                s.clear()
        else:
            self.cursor.update((cutter.at, cutter.want, upto, size))
            for s, values in ((self.tail, [(x,) for x in cutter.levels]), (self.early, sorted(early.items()))):
                s.put(values) if values else s.clear()
        if out:
            yield frame_of([(key[0], *w) for w in out], ["m", "first", "last"])


def cut_stream(frames: DataFrame, make) -> DataFrame:
    """Windows (m, first, last frame + 1) of ``frames`` (m long, frame from 0, rms), as soon as each can be told; ``make()`` gives a recording's cutter.

    A row with a null rms tells, in frame, how many frames the recording has; with the last of
    them its rest is given out and its state dropped.  Frames count in their own
    order and once each, so any split into batches gives the same windows.
    """
    rows = frames.selectExpr("m", "cast(frame as long) AS frame", "cast(rms as double) AS rms")
    return rows.groupBy("m").transformWithStateInPandas(Cuts(make), "m long, first long, last long", "append", "None")
