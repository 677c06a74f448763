"""Predicates and small conversions of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Day names, Monday first. Fixed values.
DAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")


def sanitised(c: Column, most: int) -> Column:
    """Control characters to spaces, then at most so many characters."""
    return F.left(F.regexp_replace(c, r"[\x00-\x1F\x7F]+", " "), F.lit(most))


def server_email(c: Column) -> Column:
    """The lower-cased address, '' if it isn't one."""
    m = F.lower(F.trim(c))
    return F.when(m.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), m).otherwise("")


def client_email(c: Column) -> Column:
    m = F.trim(c)
    return (F.char_length(m) <= 200) & m.rlike(r"^[^@\s]{1,64}@[^@\s.]+(?:\.[^@\s.]+)+$")


def code(c: Column) -> Column:
    return F.left(F.regexp_replace(c, "[^A-Za-z0-9_.-]", ""), F.lit(40))


#: Words that name nobody, alone or with a number; words that do so alone. Fixed values.
NUMBERED, ALONE = ("voix", "locuteur", "speaker", "intervenant", "personne", "participant"), ("interlocuteur", "inconnu", "unknown")


def placeholder(name: Column) -> Column:
    """A name nobody chose: empty, a numbered voice or speaker, or somebody unknown."""
    pattern = rf"(?iU)^(?:(?:{'|'.join(NUMBERED)})\s*[-_ ]?\d*|{'|'.join(ALONE)})?$"
    return F.coalesce(F.regexp_replace(name, r"(?U)^\s+|\s+$", "").rlike(pattern), F.lit(True))


def silent(rms: Column, peak: Column) -> Column:
    return (peak < 0.01) | (rms < 0.003)


def trusted(avg: Column, low: Column, mid: Column, least: float = 0.90, most_low: float = 0.02, most_mid: float = 0.10) -> Column:
    """Whether the small model's words are sure enough."""
    return (avg >= least) & (low <= most_low) & (mid <= most_mid)


def recent_duplicates(df: DataFrame, key: str, at: str, value: str, last: int, seconds: int) -> DataFrame:
    """Adds whether one of the key's ``last`` rows before has the same value and is less than ``seconds`` old."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(-last, -1)
    before = F.collect_list(F.struct(F.col(value).alias("v"), F.unix_micros(at).alias("t"))).over(w)
    return df.withColumn("duplicate", F.exists(before, lambda b: (b.v == F.col(value)) & (F.unix_micros(at) - b.t < seconds * 1_000_000)))


#: Letters of a notes app's date pattern that are understood, and signs that may stand between them. Fixed values.
DATE_LETTERS, DATE_SIGNS, DATE_DEFAULT = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm"}, "-_./: ", "yyyy-MM-dd"


def moment_format(at: Column, pattern: str | None) -> Column:
    """A date in the letters notes apps use (YYYY, MM, DD, HH, mm) with plain signs between; any other pattern, or none, is YYYY-MM-DD."""
    parts = re.findall("|".join(DATE_LETTERS) + "|.", pattern or "", re.S)
    if not parts or not all(p in DATE_LETTERS or p in DATE_SIGNS for p in parts):
        return F.date_format(at, DATE_DEFAULT)
    return F.date_format(at, "".join(DATE_LETTERS.get(p) or f"'{p}'" for p in parts))


def iso_epoch(c: Column) -> Column:
    """Epoch seconds of a date, a local date and time or one in UTC (Z); null if it is none."""
    t = F.replace(F.trim(c), F.lit("T"), F.lit(" "))
    utc = F.regexp_replace(t, "Z$", "+00:00")
    return F.coalesce(*[F.unix_timestamp(F.try_to_timestamp(utc, F.lit(p))) for p in ("yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mmXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")])


def humanised(at: Column, now: Column) -> Column:
    """When something is due, as one says it."""
    days, clock = F.datediff(at, now), F.date_format(at, "HH:mm")
    day = F.element_at(F.array(*map(F.lit, DAYS)), F.weekday(at) + 1)
    head = F.when(days == 0, "aujourd'hui").when(days == 1, "demain").when(days.between(2, 6), day).otherwise(F.concat(F.lit("le "), F.date_format(at, "dd/MM")))
    return F.concat(head, F.lit(" à "), clock)


def next_weekday(day: Column, index: int, force: bool = False) -> Column:
    """The next day of that index (Monday 0), today included unless forced past it."""
    ahead = F.pmod(F.lit(index) - F.weekday(day), F.lit(7))
    return F.date_add(day, F.when(ahead == 0, 7 if force else 0).otherwise(ahead))
