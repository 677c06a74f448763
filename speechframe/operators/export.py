"""Exports of speaker blocks: SRT, text, Markdown; notes with lines under headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, rounded to the millisecond, never negative."""
    ms = F.greatest(F.lit(0), F.round(seconds * 1000).cast("long"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(F.floor(ms / 3_600_000)), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def speaker_label(speaker: Column, names: Column | None = None) -> Column:
    """The name a speaker has been given, else its number counted from one."""
    number = F.substring_index(speaker, "_", -1).try_cast("int") + 1
    default = F.coalesce(F.concat(F.lit("Voix "), number.cast("string")), speaker)
    return F.coalesce(F.nullif(names, F.lit("")), default) if names is not None else default


def joined(df: DataFrame, key: str, order: str, line: Column, between: str) -> DataFrame:
    """(key, content): lines of a key in order. A key is one file, so its lines fit a row."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x")).select(key, F.array_join("x.l", between).alias("content"))


def srt(blocks: DataFrame, key: str = "meeting_id", order: str = "ord") -> DataFrame:
    """Subtitles of blocks (key, ord from 0, start, end, label, text)."""
    line = F.concat((F.col(order) + 1).cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"), F.col("label"), F.lit(": "), F.col("text"))
    return joined(blocks, key, order, line, "\n\n")


def markdown(blocks: DataFrame, key: str = "meeting_id", order: str = "ord") -> DataFrame:
    return joined(blocks, key, order, F.concat(F.lit("**"), F.col("label"), F.lit("**: "), F.col("text")), "\n\n")


def plain(blocks: DataFrame, key: str = "meeting_id", order: str = "ord") -> DataFrame:
    return joined(blocks, key, order, F.concat(F.col("label"), F.lit(": "), F.col("text")), "\n")


def under_heading(notes: DataFrame, lines: DataFrame) -> DataFrame:
    """Puts lines (note, section, ord, line) under "## section" of notes (note, content), the latest first; headings and notes that are missing are made."""
    new = lines.groupBy("note", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line")), asc=False), lambda s: s.line), "\n").alias("block"))
    parts = new.groupBy("note").agg(F.sort_array(F.collect_list(F.struct("section", "block"))).alias("parts"))

    def put(content: Column, p: Column) -> Column:
        head = F.concat(F.lit("## "), p.section)
        text = F.concat(F.lit("\n"), content, F.lit("\n"))
        at = F.instr(text, F.concat(F.lit("\n"), head, F.lit("\n")))
        after = at + F.char_length(head) + 1
        inside = F.concat(F.substring(text, F.lit(2), after - 1), p.block, F.lit("\n"), F.substring(text, after + 1, F.char_length(text) - after - 1))
        return F.when(at > 0, inside).otherwise(F.concat(content, F.when(content != "", F.lit("\n")).otherwise(F.lit("")), head, F.lit("\n"), p.block))

    out = notes.join(parts, "note", "full").withColumn("content", F.coalesce("content", F.lit("")))
    return out.select("note", F.aggregate(F.coalesce("parts", F.array().cast("array<struct<section:string,block:string>>")), F.col("content"), put).alias("content"))
