"""Time-varying mixing of sources to target weights, in DataFrame functions only.

A source's weight is a schedule over training time 0 to 1: straight lines
between knots.  Its integral is the source's share; shares split the budget, no
source gets more than ``most`` times its size, and what that leaves over is
reshared by weight until no source is above (`level`).  A source's cumulative
demand at time t is its target times the part of the integral before t.  Its
documents stand in a fixed pseudo-random order (md5 of the id); a document whose
words begin at offset c of its source's stream is due when the demand reaches c,
so the integral is inverted there in closed form.  Sorting by due time, a range
shuffle, is the curriculum.

A document is taken whole until its source's target is met; the last one is cut,
so that a source's words are its target rounded down.  Above one size the
stream starts again, so no document is taken more than ``most`` times.

Offsets are prefix sums in two steps, so that no source is one task however many
rows it has: documents fall in about 4 * sqrt(rows) buckets by the first bits of
their md5, sums of (source, bucket) are added up along a source, and documents
are added up inside a bucket.

Defined results: a null text has size 0; null sources are one source, the last;
rows that share an id stand next to each other by size, each with words of its
own; null ids stand where the empty string's md5 does; documents without words
are never due; an empty table gives no row.  Extra columns aren't carried along:
the result is joined back by its id.
"""

from __future__ import annotations

from math import ceil, log2, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

Knots = tuple[tuple[float, float], ...]
#: Sources take these in turn: one that fades, one that stays, one that grows. Integrals 3, 1 and 2.
SCHEDULES: tuple[Knots, ...] = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))


def integrals(knots: Knots) -> list[float]:
    """The integral of a schedule up to each of its knots."""
    assert len(knots) > 1 and knots[0][0] == 0 and knots[-1][0] == 1 and all(a[0] < b[0] for a, b in zip(knots, knots[1:])) and min(w for _, w in knots) >= 0, "knots run from time 0 to 1 with weights of at least 0"
    out = [0.0]
    for (t, w), (u, x) in zip(knots, knots[1:]):
        out.append(out[-1] + (u - t) * (w + x) / 2)
    return out


def time_of(area: Column, knots: Knots) -> Column:
    """The time at which a schedule's integral reaches ``area``: per piece the root of a quadratic, in the form that doesn't cancel."""
    sums, out = integrals(knots), None
    for (t, w), (u, x), low, high in zip(knots, knots[1:], sums, sums[1:]):
        rest = area - F.lit(low)
        here = F.when(rest <= 0, F.lit(t)).otherwise(F.lit(t) + 2 * rest / (F.lit(w) + F.sqrt(F.lit(w * w) + F.lit(2 * (x - w) / (u - t)) * rest)))
        out = F.when(area < high, here) if out is None else out.when(area < high, here)
    return out.otherwise(F.lit(1.0))


def word_count(text: Column) -> Column:
    """Runs of anything but the six ASCII blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(df: DataFrame, by: str) -> DataFrame:
    """df with ``rank``, from 0 in the order of ``by``: a range sort, then the sizes of its partitions before each (a row a partition in one task)."""
    parts = cut_lineage(df.repartitionByRange(by).withColumn("__part", F.spark_partition_id()))
    before = parts.groupBy("__part").agg(F.count("*").alias("n")).select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(by)) - 1
    return parts.withColumn("rank", inside).join(before, "__part").withColumn("rank", F.col("rank") + F.col("__before")).drop("__part", "__before")


def level(sources: DataFrame, budget: float) -> float:
    """Words per unit of weight once no source is above its ``cap``: each round reshares what capped sources leave. One row a round comes to the driver."""
    at = 0.0
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(at)
        r = sources.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("full"), F.sum(F.when(~over, F.col("weight")).otherwise(0.0)).alias("open")).first()
        if not r.open or not (now := (budget - r.full) / r.open) > at:
            return at if r.open or not at else float("inf")
        at = now


def targets(sizes: DataFrame, schedules: tuple[Knots, ...], budget: float, most: float, choose: Column | None = None) -> DataFrame:
    """``sizes`` (key, source_size) with schedule, weight and target. ``choose`` is the number of a source's schedule, by default its rank modulo theirs; budget is a multiple of all words."""
    chosen = (F.col("rank") % len(schedules) if choose is None else choose).cast("int")
    weight = F.element_at(F.array(*[F.lit(integrals(k)[-1]) for k in schedules]), F.col("schedule") + 1)
    df = cut_lineage(ranked(sizes, "key").withColumn("schedule", chosen).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    words = df.agg(F.sum("source_size")).first()[0] or 0
    at = level(df, budget * words)
    return df.withColumn("target", F.when(F.col("weight") == 0, 0.0).otherwise(F.least("cap", F.col("weight") * F.lit(at)))).drop("cap", "rank")


def mix(docs: DataFrame, schedules: tuple[Knots, ...] = SCHEDULES, budget: float = 1.5, most: int = 2, choose: Column | None = None) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source), one row a document.

    Returns doc_id, source, size, source_size, target, taken (words, repeats
    counted) and takes: an array of (position, words), one a pass, position the
    training time from 0 to 1 at which the pass of the document is due.  ``choose``
    may use ``rank`` (of the source, by code point, null last) and ``source_size``.
    """
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    slim = cut_lineage(docs.select("doc_id", "source", key.alias("key"), word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("draw")))
    sizes = slim.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = targets(sizes, schedules, budget, most, choose)
    rows = goals.agg(F.sum("n")).first()[0] or 0
    bits = min(32, max(1, ceil(log2(4 * sqrt(rows + 1)))))
    slim = slim.withColumn("bucket", F.shiftright(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), 32 - bits))
    along = Window.partitionBy("key").orderBy("bucket")
    sums = slim.groupBy("key", "bucket").agg(F.sum("size").alias("words")).withColumn("before", F.sum("words").over(along) - F.col("words")).drop("words")
    sums = sums.join(goals.drop("n"), "key")
    inside = Window.partitionBy("key", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = slim.withColumn("upto", F.sum("size").over(inside)).join(sums, ["key", "bucket"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    return placed.withColumn("takes", _takes(schedules, most)).select(
        "doc_id", "source", "size", "source_size", "target", F.aggregate("takes", F.lit(0).cast("long"), lambda n, t: n + t["words"]).alias("taken"), "takes")


def _takes(schedules: tuple[Knots, ...], most: int) -> Column:
    """Passes of a document that begin before its source's target, with the words that the target leaves it."""

    def one(n: int) -> Column:
        start = F.col("start") + F.lit(n) * F.col("source_size")
        words = F.least("size", F.greatest(F.lit(0), F.floor("target") - start)).cast("long")
        due = None
        for i, knots in enumerate(schedules):
            area = start * F.lit(integrals(knots)[-1]) / F.col("target")
            due = F.when(F.col("schedule") == i, time_of(area, knots)) if due is None else due.when(F.col("schedule") == i, time_of(area, knots))
        return F.when(words > 0, F.struct(due.alias("position"), words.alias("words")))

    return F.filter(F.array(*[one(n) for n in range(ceil(most))]), lambda t: t.isNotNull())


def training_order(mixed: DataFrame) -> DataFrame:
    """What to train on, in order: (position, doc_id, source, words, epoch), a row a pass, range-sorted by position."""
    flat = mixed.select("doc_id", "source", F.posexplode("takes").alias("epoch", "t"))
    return flat.select("t.position", "doc_id", "source", "t.words", "epoch").orderBy("position", "doc_id", "epoch")


def by_document(mixed: DataFrame) -> DataFrame:
    """A row a document, range-sorted by its first position; those not taken come last."""
    first = F.try_element_at("takes", F.lit(1))["position"]
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"))
    return out.orderBy(F.asc_nulls_last("position"), "doc_id", "size")


#: In the order of cap over weight, the level with the first sources capped rises until those that are above have all gone, then falls: it is the greatest.
ORACLE_SQL = """
    WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
                      md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
    s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY k) - 1) % 3 AS c FROM d GROUP BY k),
    w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][c + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
    o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
                 sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, sum(source_size) OVER () AS words FROM w),
    l AS (SELECT max((1.5::DOUBLE * words - filled) / weights) AS level FROM o),
    g AS (SELECT k, source_size, c, w, least(cap, w * level) AS target FROM w, l),
    p AS (SELECT doc_id, d.k, size, sum(size) OVER (PARTITION BY d.k ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start, source_size, c, w, target FROM d JOIN g ON g.k = d.k),
    t AS (SELECT *, least(size, greatest(0, floor(target) - start)) AS t1, least(size, greatest(0, floor(target) - start - source_size)) AS t2, start * w / target AS a FROM p)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(t1 + t2 AS BIGINT) AS taken,
           CASE WHEN t1 = 0 THEN NULL WHEN a <= 0 THEN 0.0::DOUBLE ELSE 2 * a / ([4, 1, 1][c + 1] + sqrt([16, 1, 1][c + 1] + [-4, 0, 4][c + 1] * a)) END AS position
    FROM t"""
