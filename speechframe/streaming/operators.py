"""Streaming forms of the windowed operators. Event times are instants; "now" comes with the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import KeyedStore


def drain(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is available and stops."""
    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


#: Keys share so many groups of state: a call of Python costs milliseconds, however few rows it gets.
BUCKETS = 1024


def suppress_repeats(events: DataFrame, key: str, value: str, at: str, seconds: float = 10.0, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Drops an event equal to the key's last accepted one of that value less than ``seconds`` before.

    The last accepted time is explicit state: a watermarked duplicate filter would drop repeats however far apart within a batch.
    It counts until the watermark (``late`` behind the latest event) has passed the time in which it can drop
    anything. Keys and values are dealt to ``buckets`` groups by a hash; of a bucket's events of a batch
    only codes, times and ids are held, 20 bytes each, and accepted ones are found by search, not row by row. What has expired
    goes when the bucket gets events again, and all of it once the last time has.
    """
    span = round(seconds * 1e6)

    def until(t: int) -> int:
        return (t + span) // 1000 + 1

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = {(k, v): t for k, v, t in zip(*state.get)} if state.exists else {}
        codes: dict = {}
        parts = [(np.fromiter((codes.setdefault(x, len(codes)) for x in zip(b[key], b[value])), "int32", len(b)), b[at].astype("datetime64[us]").astype("int64").to_numpy(), b["event_id"].to_numpy()) for b in batches]
        code, times, ids = (np.concatenate([x[i] for x in parts]) for i in (0, 1, 2))
        order = np.lexsort((ids, times, code))
        code, times, ids = code[order], times[order], ids[order]
        ends, names, keep = np.searchsorted(code, np.arange(len(codes)), "right").tolist(), list(codes), []
        for name, a, b in zip(names, [0, *ends], ends):
            own = times[a:b]
            i = int(own.searchsorted(last[name] + span)) if name in last else 0
            while i < len(own):
                keep.append(a + i)
                last[name] = int(own[i])
                i = int(own.searchsorted(last[name] + span))
        now = state.getCurrentWatermarkMs()
        live = [(k, v, t) for (k, v), t in last.items() if until(t) > now]
        if live:
            state.update(tuple(map(list, zip(*live))))
            state.setTimeoutTimestamp(until(max(t for *_, t in live)))
        elif state.exists:
            state.remove()
        if keep:
            whose = [names[c] for c in code[keep].tolist()]
            own = pd.array([None if k is None else int(k) for k, _ in whose], dtype="Int64")
            yield pd.DataFrame({key: own, value: [v for _, v in whose], at: pd.to_datetime(times[keep], unit="us"), "event_id": ids[keep]})

    schema = f"{key} long, {value} string, {at} timestamp, event_id long"
    dealt = F.pmod(F.xxhash64(key, value), F.lit(buckets)).alias("__bucket")
    rows = events.select(dealt, F.col(key).cast("string").alias(key), value, at, "event_id").withWatermark(at, late)
    return rows.groupBy("__bucket").applyInPandasWithState(run, schema, "keys array<string>, vals array<string>, lasts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def tiles(frames: DataFrame, key: str, at: str, level: str, late: str = "1 hour") -> DataFrame:
    """Two-second tiles each second with their mean square level, final once the watermark has passed."""
    return frames.withWatermark(at, late).groupBy(key, F.window(at, "2 seconds", "1 second").alias("t")).agg(F.avg(F.col(level) * F.col(level)).alias("square"), F.count("*").alias("n"))


def aligned(mic: DataFrame, system: DataFrame, at: str, slack: str = "10 seconds") -> DataFrame:
    """The microphone is the clock: each of its frames with the system's of the same time, silence where that is late. Columns: key, slot, at, x."""
    m = mic.withWatermark(at, slack).alias("m")
    s = system.withWatermark(at, slack).alias("s")
    j = m.join(s, F.expr(f"m.key = s.key and m.slot = s.slot and s.{at} between m.{at} - interval {slack} and m.{at} + interval {slack}"), "left")
    return j.select("m.key", "m.slot", F.col(f"m.{at}").alias(at), F.col("m.x").alias("mic"), F.coalesce("s.x", F.lit(0.0)).alias("sys"))


def replayed(reports: DataFrame, store: KeyedStore, rules: dict[str, str], checkpoint: str) -> None:
    """Keyed replacement in a stored table by each batch, which rewrites only the buckets of its keys; a batch that comes again changes nothing."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch.groupBy(*store.keys).agg(*[F.max(c).alias(c) for c in rules]), rules, batch_id)

    drain(reports, sink, checkpoint)
