"""Operators over ordered rows of a key: islands, smoothing, gap filling, votes on a grid.

Each takes the key columns and an order with ties broken; where a rule looks at
its own earlier output it is a fold (see ``folds``), never a lag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def islands(df: DataFrame, key: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Adds ``island``, a number that grows where ``breaks`` (over lagged columns) is true; the first row starts one."""
    w = ordered(key, order)
    return df.withColumn("island", F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def blocks(words: DataFrame, key: list[str], order: list[str], speaker: str = "speaker", between: str | None = None, extra: Column | None = None) -> DataFrame:
    """Runs of one speaker: start of the first word, end of the last (even if an earlier one ends later), text in order.

    Texts are joined by ``between``, or as they are where a key's words carry leading spaces (None: by looking at its first 80).
    """
    w = ordered(key, order)
    breaks = F.col(speaker) != F.lag(speaker).over(w)
    if extra is not None:
        breaks = breaks | extra
    at = islands(words, key, order, breaks).withColumn("__n", F.row_number().over(w))
    if between is None:
        at = at.withColumn("__raw", F.max((F.col("__n") <= 80) & F.startswith("word", F.lit(" "))).over(Window.partitionBy(*key)))
    else:
        at = at.withColumn("__raw", F.lit(False))
    piece = F.when(F.col("__raw"), F.col("word")).otherwise(F.trim("word"))
    g = at.groupBy(*key, "island", speaker).agg(F.min_by("start", "__n").alias("start"), F.max_by("end", "__n").alias("end"), F.first("__raw").alias("raw"), F.sort_array(F.collect_list(F.struct("__n", piece.alias("p")))).alias("x"))
    text = F.when(F.col("raw"), F.array_join("x.p", "")).otherwise(F.array_join("x.p", " " if between is None else between))
    return g.select(*key, "island", speaker, "start", "end", F.trim(text).alias("text"))


def units(words: DataFrame, key: list[str], order: list[str], pause: float = 0.25) -> DataFrame:
    """Speech units: a new one after a gap of at least ``pause``."""
    return islands(words, key, order, F.col("start") - F.lag("end").over(ordered(key, order)) >= pause)


def paragraphs(segments: DataFrame, key: list[str], order: list[str], gap: float = 2.0) -> DataFrame:
    """Numbers paragraphs: a new one after a gap of over ``gap`` if the current one has text; rows without text still move the last end."""
    w = ordered(key, order)
    far = F.col("start") - F.lag("end").over(w) > gap
    # Gaps are counted first; paragraphs are the counts at which text occurs.
    stretch = islands(segments, key, order, F.coalesce(far, F.lit(False))).withColumnRenamed("island", "__s")
    return stretch.where("text <> ''").withColumn("island", F.dense_rank().over(Window.partitionBy(*key).orderBy("__s"))).drop("__s")


def single_flips(df: DataFrame, key: list[str], order: list[str], c: str) -> Column:
    """A label between two equal others becomes theirs; judged on the labels as they came."""
    w = ordered(key, order)
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.when((before == after) & (F.col(c) != before), before).otherwise(F.col(c))


def merge_close(segments: DataFrame, key: list[str], gap: float = 0.5, speaker: str = "speaker") -> DataFrame:
    """Neighbours of one speaker at most ``gap`` apart become one."""
    w = ordered(key, ["start", "ord"])
    apart = (F.col(speaker) != F.lag(speaker).over(w)) | (F.col("start") - F.lag("end").over(w) > gap)
    at = islands(segments, key, ["start", "ord"], apart)
    return at.groupBy(*key, "island", speaker).agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "ord")).alias("end"))


def grid_vote(windows: DataFrame, key: list[str], grid: float = 0.5, gap: float = 0.75, label: str = "label") -> DataFrame:
    """Overlapping windows to segments: the majority in each cell of the grid (ties to the label seen first), runs of a label at most ``gap`` apart joined."""
    last = Window.partitionBy(*key)
    w = windows.withColumn("__last", F.floor(F.max_by("end", F.struct("start", "ord")).over(last) / grid))
    cell = F.explode(F.sequence(F.floor(F.col("start") / grid), F.least(F.floor(F.col("end") / grid), F.col("__last"))))
    votes = w.select(*key, "ord", label, cell.alias("cell")).groupBy(*key, "cell", label).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = votes.groupBy(*key, "cell").agg(F.max_by(label, F.struct("n", -F.col("first"))).alias(label))
    cells = best.select(*key, F.col(label), (F.col("cell") * grid).alias("start"), (F.col("cell") * grid + grid).alias("end"), F.col("cell").alias("ord"))
    return merge_close(cells, key, gap, label)


def fill_gaps(segments: DataFrame, key: list[str], length: Column, speaker: str = "speaker") -> DataFrame:
    """Gaps are shared at their middle, the first start is 0, the last end the whole length; then neighbours of one speaker are joined."""
    w = ordered(key, ["start", "ord"])
    before, after = F.lag("end").over(w), F.lead("start").over(w)
    start = F.when(before.isNull(), 0.0).when(F.col("start") > before, (before + F.col("start")) / 2).otherwise(F.col("start"))
    end = F.when(after.isNull(), length).when(after > F.col("end"), (F.col("end") + after) / 2).otherwise(F.col("end"))
    at = segments.withColumns({"__s": start, "__e": end}).withColumns({"start": F.col("__s"), "end": F.col("__e")}).drop("__s", "__e")
    run = islands(at, key, ["start", "ord"], F.col(speaker) != F.lag(speaker).over(w))
    return run.groupBy(*key, "island", speaker).agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "ord")).alias("end"))


def link_evidence(regions: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """Per pair of labels: how often they are neighbours in time, and how often inside one segment."""
    w = ordered(key, ["start", "ord"])
    n = regions.withColumns({"__b": F.lead(label).over(w), "__same": F.lead("seg_id").over(w) == F.col("seg_id")}).where(F.col("__b") != F.col(label))
    g = n.groupBy(*key, F.least(label, "__b").alias("a"), F.greatest(label, "__b").alias("b")).agg(F.count("*").alias("adjacent"), F.count_if("__same").alias("links"))
    return g.withColumn("rate", F.col("links") / F.col("adjacent"))


def reassign(blocks_: DataFrame, key: list[str], edits: DataFrame) -> DataFrame:
    """Words [first, last) of a block go to a new speaker; times are shared by word counts. edits: (key, ord, first, last, speaker)."""
    e = edits.select(*key, "ord", F.greatest(F.lit(0), "first").alias("first"), "last", F.col("speaker").alias("new"))
    j = blocks_.join(e, [*key, "ord"], "left").withColumn("w", F.filter(F.split("text", r"\s+"), lambda x: x != "")).withColumn("n", F.size("w"))
    lo, hi = F.col("first"), F.least("last", "n")
    dur = (F.col("end") - F.col("start")) / F.greatest(F.lit(1), F.col("n"))
    part = lambda speaker, a, b: F.struct(speaker.alias("speaker"), F.array_join(F.slice("w", a + 1, b - a), " ").alias("text"), (F.col("start") + dur * a).alias("start"), (F.col("start") + dur * b).alias("end"))
    edited = F.filter(F.array(part(F.col("speaker"), F.lit(0), lo), part(F.col("new"), lo, hi), part(F.col("speaker"), hi, F.col("n"))), lambda p: p.text != "")
    kept = F.array(F.struct("speaker", "text", "start", "end"))
    out = j.select(*key, "ord", F.posexplode(F.when(F.col("new").isNotNull() & (lo < hi), edited).otherwise(kept)).alias("piece", "p")).select(*key, "ord", "piece", "p.*")
    w = ordered(key, ["ord", "piece"])
    run = islands(out, key, ["ord", "piece"], F.col("speaker") != F.lag("speaker").over(w))
    g = run.groupBy(*key, "island", "speaker").agg(F.min_by("start", F.struct("ord", "piece")).alias("start"), F.max_by("end", F.struct("ord", "piece")).alias("end"), F.sort_array(F.collect_list(F.struct("ord", "piece", "text"))).alias("x"))
    return g.select(*key, "island", "speaker", "start", "end", F.array_join("x.text", " ").alias("text"))


def uncertain(windows: DataFrame, key: list[str], margin: float = 0.18, trip: float = 0.06) -> DataFrame:
    """Flags windows of a small margin or beside a change of label; all of a key where small margins are frequent."""
    w = ordered(key, ["start", "ord"])
    low = F.col("margin") < margin
    edge = (F.col("label") != F.lag("label").over(w)) | (F.col("label") != F.lead("label").over(w))
    dense = F.avg(low.cast("int")).over(Window.partitionBy(*key)) > trip
    return windows.withColumn("uncertain", low | F.coalesce(edge, F.lit(False)) | dense)
