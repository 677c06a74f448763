"""Joins of points and intervals.

A range predicate alone would be planned as a nested loop.  Intervals are
exploded to bins of time instead, which gives an equality key; the predicate is
checked again and each pair is met in one bin only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(c: Column, width: float) -> Column:
    return F.floor(c / width)


def nearest_segment(points: DataFrame, segments: DataFrame, key: list[str], t: str, width: float = 10.0, unknown: str = "SPEAKER_UNKNOWN") -> DataFrame:
    """Adds the speaker at a point: of the first listed segment that holds it (edges included), else of the nearest (ties to the first), else ``unknown``.

    points must have a unique ``pid``.  The nearest segment has the latest end before the point or the
    earliest start after it: two ordered lookups, not a comparison with every segment.
    """
    s = segments.select(*key, "ord", "start", "end", "speaker")
    binned = s.withColumn("bin", F.explode(F.sequence(_bin(F.col("start"), width), _bin(F.col("end"), width))))
    p = points.select(*key, "pid", F.col(t).alias("at"))
    inside = p.withColumn("bin", _bin(F.col("at"), width)).join(binned, [*key, "bin"]).where((F.col("start") <= F.col("at")) & (F.col("at") <= F.col("end")))
    held = inside.groupBy("pid").agg(F.min_by("speaker", "ord").alias("held"))
    # As-of lookups in one sorted union per side.
    none = F.lit(None)
    ends = s.groupBy(*key, "end").agg(F.min("ord").alias("ord"), F.min_by("speaker", "ord").alias("speaker")).select(*key, F.col("end").alias("at"), none.cast("long").alias("pid"), F.struct(F.col("end").alias("x"), "ord", "speaker").alias("hit"), F.lit(0).alias("side"))
    starts = s.groupBy(*key, "start").agg(F.min("ord").alias("ord"), F.min_by("speaker", "ord").alias("speaker")).select(*key, F.col("start").alias("at"), none.cast("long").alias("pid"), F.struct(F.col("start").alias("x"), "ord", "speaker").alias("hit"), F.lit(0).alias("side"))
    asked = p.select(*key, "at", "pid", none.cast(ends.schema["hit"].dataType).alias("hit"), F.lit(1).alias("side"))
    back = Window.partitionBy(*key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy(F.desc("at"), "side").rowsBetween(Window.unboundedPreceding, 0)
    left = ends.unionByName(asked).withColumn("l", F.last("hit", True).over(back)).where("pid is not null").select("pid", "at", "l")
    right = starts.unionByName(asked).withColumn("r", F.last("hit", True).over(ahead)).where("pid is not null").select("pid", "r")
    both = left.join(right, "pid").withColumns({"dl": F.col("at") - F.col("l.x"), "dr": F.col("r.x") - F.col("at")})
    pick = F.when(F.col("l").isNull(), F.col("r.speaker")).when(F.col("r").isNull(), F.col("l.speaker")).when((F.col("dl") < F.col("dr")) | ((F.col("dl") == F.col("dr")) & (F.col("l.ord") < F.col("r.ord"))), F.col("l.speaker")).otherwise(F.col("r.speaker"))
    near = both.select("pid", pick.alias("near"))
    return points.join(held, "pid", "left").join(near, "pid", "left").withColumn("speaker", F.coalesce("held", "near", F.lit(unknown))).drop("held", "near")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """As many partitions as given: ids and times are few bytes when shuffled, and partitions put together by bytes would be one task's rows, many times as large in memory."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def overlap_pairs(left: DataFrame, right: DataFrame, key: list[str], width: float = 10.0) -> DataFrame:
    """Pairs whose intervals overlap strictly: (lid, seconds, columns of right); met in the bin where the later of the two starts."""
    a = left.select(*key, "lid", F.col("start").alias("s1"), F.col("end").alias("e1")).withColumn("bin", F.explode(F.sequence(_bin(F.col("s1"), width), _bin(F.col("e1"), width))))
    b = right.withColumn("bin", F.explode(F.sequence(_bin(F.col("start"), width), _bin(F.col("end"), width))))
    j = dealt(a, *key, "bin").join(dealt(b, *key, "bin"), [*key, "bin"]).where((F.col("start") < F.col("e1")) & (F.col("end") > F.col("s1")) & (F.col("bin") == _bin(F.greatest("s1", "start"), width)))
    return j.withColumn("seconds", F.least("e1", "end") - F.greatest("s1", "start"))


def majority(left: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """(lid, label): the label of most overlapping windows, ties to the lowest."""
    n = dealt(overlap_pairs(left, windows, key).select("lid", "label"), "lid").groupBy("lid", "label").agg(F.count("*").alias("n"))
    return n.groupBy("lid").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def weighted(left: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """(lid, label, share): the label with most overlapping time, ties to the lowest, and its share."""
    n = dealt(overlap_pairs(left, windows, key).select("lid", "label", "seconds"), "lid").groupBy("lid", "label").agg(F.round(F.sum("seconds"), 9).alias("s"))
    return n.groupBy("lid").agg(F.max_by("label", F.struct("s", -F.col("label"))).alias("label"), (F.max("s") / F.sum("s")).alias("share"))


def as_of(points: DataFrame, windows: DataFrame, key: list[str], t: str, value: str) -> DataFrame:
    """Adds the value of the last window that starts at or before t; before the first, of the first."""
    w = windows.select(*key, F.col("start").alias("at"), F.col(value).alias("v"), F.lit(0).alias("side"), "ord").withColumn("p", F.lit(None).cast(points.select(F.struct("*").alias("p")).schema["p"].dataType))
    p = points.select(*key, F.col(t).alias("at"), F.lit(None).cast(windows.schema[value].dataType).alias("v"), F.lit(1).alias("side"), F.lit(None).cast(windows.schema["ord"].dataType).alias("ord"), F.struct(*points.columns).alias("p"))
    both = w.select("at", "v", "side", "ord", "p", *key).unionByName(p)
    order = Window.partitionBy(*key).orderBy("at", "side", "ord").rowsBetween(Window.unboundedPreceding, 0)
    first = windows.groupBy(*key).agg(F.min_by(value, F.struct("start", "ord")).alias("first_v"))
    return both.withColumn("v", F.last("v", True).over(order)).where("side = 1").select("p.*", "v").join(first, key, "left").withColumn(value, F.coalesce("v", "first_v")).drop("v", "first_v")


def by_source(blocks: DataFrame, levels: DataFrame, key: list[str], step: float = 0.05) -> DataFrame:
    """The louder of two sources over a block's slices of ``step`` seconds: mic 00, else 01 (ties included). blocks have a unique ``lid``."""
    lo = F.floor(F.col("start") / step)
    slices = blocks.withColumn("block", F.explode(F.sequence(lo, F.greatest(lo, F.floor(F.col("end") / step) - 1))))
    m = slices.join(levels, [*key, "block"]).groupBy("lid").agg(F.avg("mic_rms").alias("__mic"), F.avg("sys_rms").alias("__sys"))
    return blocks.join(m, "lid", "left").withColumn("speaker", F.when(F.col("__mic") > F.col("__sys"), "SPEAKER_00").when(F.col("__mic").isNotNull(), "SPEAKER_01").otherwise(F.col("speaker"))).drop("__mic", "__sys")
