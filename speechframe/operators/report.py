"""The usage report as a batch: sanitise, admit, three keyed merges.

A report row is (install struct, usage json, incidents json).  At most 31 days
and 200 incidents of a report are taken, from the start of its arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from . import upsert

#: Caps of a day's counters. Fixed values.
CAPS = {"dictations": 100_000, "words": 10_000_000, "meetings": 10_000}
CAPS_S = {"seconds_saved": 10_000_000.0, "audio_seconds": 86_400.0}
MOST_DAYS, MOST_INCIDENTS, MOST_NEW, NEW_SECONDS = 31, 200, 300, 3600
USAGE = "array<struct<day:date,dictations:int,words:int,meetings:int,seconds_saved:double,audio_seconds:double>>"
INCIDENTS = "array<struct<day:date,code:string,count:int>>"


def _clamp(c: Column, most) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(type(most)(0)), F.coalesce(c, F.lit(type(most)(0)))))


def rows(reports: DataFrame, column: str, kind: str, most: int) -> DataFrame:
    """(install_id, seq, fields) of a JSON array; a null or broken one has no rows."""
    return reports.select("install_id", "seq", F.explode(F.slice(F.coalesce(F.from_json(column, kind), F.array().cast(kind)), 1, most)).alias("r")).select("install_id", "seq", "r.*")


def apply_report(installs: DataFrame, usage: DataFrame, incidents: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after the reports (install_id, seq, at, first_name, email, usage, incidents). The last report of a key wins."""
    known = reports.where(F.col("install_id").rlike("^[0-9a-fA-F-]{8,36}$"))
    admitted = upsert.admitted(known, installs, "install_id", "at", MOST_NEW, NEW_SECONDS)
    profile = admitted.groupBy("install_id").agg(F.max_by("first_name", "seq").alias("first_name"), F.max_by("email", "seq").alias("email"), F.max("at").alias("last_seen_at"))
    profile = profile.select("install_id", checks.sanitised(F.coalesce("first_name", F.lit("")), 60).alias("first_name"), checks.server_email(F.coalesce("email", F.lit(""))).alias("email"), "last_seen_at")
    after = upsert.merge(installs.select("install_id", "first_name", "email", F.col("at").alias("last_seen_at"), F.col("at").alias("created_at")), profile.withColumn("created_at", F.col("last_seen_at")), ["install_id"],
                         {"first_name": "replace", "email": "sticky", "last_seen_at": "greatest", "created_at": "keep"})
    days = rows(admitted, "usage", USAGE, MOST_DAYS).where("day is not null")
    counters = [*CAPS, *CAPS_S]
    last = days.groupBy("install_id", "day").agg(F.max_by(F.struct(*counters), "seq").alias("r")).select("install_id", "day", *[_clamp(F.col(f"r.{c}"), {**CAPS, **CAPS_S}[c]).alias(c) for c in counters])
    used = upsert.merge(usage, last, ["install_id", "day"], {c: "greatest" if c == "audio_seconds" else "replace" for c in counters})
    told = rows(admitted, "incidents", INCIDENTS, MOST_INCIDENTS).withColumn("code", checks.code(F.coalesce("code", F.lit("")))).where("code <> '' and day is not null")
    counts = told.groupBy("install_id", "day", "code").agg(F.max(_clamp(F.col("count"), 100_000)).alias("count"))
    return after, used, upsert.merge(incidents, counts, ["install_id", "day", "code"], {"count": "greatest"})
