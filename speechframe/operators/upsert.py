"""Keyed merges of an existing table with a delta.

Two rules for the same counters must not be mixed: local counters accumulate,
reported ones replace.  Each merge is one shuffle on the key (a union and an
aggregation, or a full outer join) and applying a replacing one twice changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accumulate(existing: DataFrame, delta: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Adds the delta's counters to the existing ones."""
    return existing.select(*keys, *sums).unionByName(delta.select(*keys, *sums)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def merge(existing: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """A full outer merge, each column by its rule.

    replace: the new value, if its row exists; greatest: the larger; sticky: the
    new value unless null or blank; keep: the existing value, if its row exists.
    """
    a, b = existing.select(*keys, F.struct(*rules).alias("old")), new.select(*keys, F.struct(*rules).alias("new"))

    def made(c: str, rule: str) -> Column:
        old, fresh = F.col(f"old.{c}"), F.col(f"new.{c}")
        if rule == "replace":
            return F.when(F.col("new").isNotNull(), fresh).otherwise(old)
        if rule == "keep":
            return F.when(F.col("old").isNotNull(), old).otherwise(fresh)
        if rule == "greatest":
            return F.greatest(old, fresh)
        if rule == "sticky":
            return F.coalesce(F.when(F.trim(fresh.cast("string")) != "", fresh), old, fresh)
        raise ValueError(rule)

    return a.join(b, keys, "full").select(*keys, *[made(c, r).alias(c) for c, r in rules.items()])


def ascii_fold(c: Column | str) -> Column:
    """A-Z to a-z only: an accented capital stays distinct."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def upsert_folded(entries: DataFrame, key: str, order: str, first: list[str], last: list[str]) -> DataFrame:
    """One row a folded key: columns ``first`` (spelling, id) of the earliest entry, ``last`` of the latest."""
    e = entries.withColumn("folded", ascii_fold(F.trim(F.col(key)))).where("folded <> ''")
    return e.groupBy("folded").agg(*[F.min_by(c, order).alias(c) for c in first], *[F.max_by(c, order).alias(c) for c in last])


def update(df: DataFrame, allowed: set[str], where: Column, **values: Column) -> DataFrame:
    """Whitelisted partial update; an unknown column is refused."""
    if unknown := set(values) - allowed:
        raise ValueError(f"not updatable: {sorted(unknown)}")
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def backfill(counted: DataFrame, history: DataFrame, day: str, sums: list[str]) -> DataFrame:
    """Adds days of the history before the first counted day (all, if none is counted).

    Running it again adds nothing: the first counted day is then the history's first.
    """
    first = counted.agg(F.min(day).alias("first_day"))
    older = history.groupBy(day).agg(*[F.sum(c).alias(c) for c in sums]).join(F.broadcast(first)).where(F.col("first_day").isNull() | (F.col(day) < F.col("first_day"))).drop("first_day")
    return accumulate(counted, older, [day], sums)


def admitted(new: DataFrame, existing: DataFrame, key: str, at: str, limit: int, seconds: int) -> DataFrame:
    """Rows of unknown keys pass only while fewer than ``limit`` keys were created in the ``seconds`` before (to the second).

    Creations are counted per second and packed per slot of ``seconds``, so a slot is one row of at most ``seconds``
    running counts; a new row looks up two slots, and no row meets the creations themselves.
    """
    t = F.unix_timestamp(at)
    slot = F.floor(t / seconds).cast("long")
    per = existing.groupBy(slot.alias("slot"), t.alias("t")).agg(F.count("*").alias("n"))
    runs = per.withColumn("upto", F.sum("n").over(Window.partitionBy("slot").orderBy("t")))
    slots = runs.groupBy("slot").agg(F.collect_list(F.struct("t", "upto")).alias("runs"))
    upto = lambda runs, x: F.coalesce(F.array_max(F.transform(F.filter(runs, lambda r: r.t <= x), lambda r: r.upto)), F.lit(0))
    unknown = new.join(existing.select(key), key, "left_anti").select(key, t.alias("__t"), slot.alias("slot"))
    own = unknown.join(slots, "slot", "left").withColumnRenamed("runs", "own").withColumn("slot", F.col("slot") - 1)
    both = own.join(slots, "slot", "left")
    before = upto(F.col("runs"), F.lit(1 << 60)) - upto(F.col("runs"), F.col("__t") - seconds)
    full = both.where(upto(F.col("own"), F.col("__t")) + before >= limit).select(key).distinct()
    return new.join(full, key, "left_anti")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule, in one pass; a null result isn't a violation."""
    counts = df.agg(*[F.count_if(~r).alias(k) for k, r in rules.items()])
    return counts.unpivot([], list(rules), "rule", "broken")


def strikes(events: DataFrame, key: str, at: str, limit: int = 3, seconds: int = 3600) -> DataFrame:
    """Each event with the number of its key's events in the ``seconds`` up to it, and what follows: a suspension, or for good."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(at)).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    out = events.withColumn("recent", F.count("*").over(w))
    return out.withColumn("action", F.when(F.col("recent") >= limit, "permanent").otherwise("suspended"))
