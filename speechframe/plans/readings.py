"""How the driver's tables are read as the engine's own: the same readings in DataFrames and in SQL.

Installs are customers; a user's clicks of a day are its dictations, its views
its meetings, ``props.k`` their words and ``value`` their seconds; error events
are incidents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cents, table, total

#: "Now" of all queries: never the wall clock.
TODAY = "2024-01-30"

USAGE_SQL = """usage AS (
    SELECT user_id AS install_id, CAST(ts AS DATE) AS day,
        CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS dictations,
        CAST(coalesce(sum(CAST(regexp_extract(props, '[0-9]+') AS INT)) FILTER (WHERE event_type = 'click'), 0) AS BIGINT) AS words,
        CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS meetings,
        CAST(coalesce(sum(CAST(regexp_extract(props, '[0-9]+') AS INT)) FILTER (WHERE event_type = 'view'), 0) AS BIGINT) AS meeting_words,
        round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0), 2) AS audio_seconds,
        round(coalesce(sum(CAST(regexp_extract(props, '[0-9]+') AS INT)) FILTER (WHERE event_type = 'click'), 0) * 1.1, 2)::DOUBLE AS seconds_saved
    FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)"""

INCIDENTS_SQL = """incidents AS (
    SELECT user_id AS install_id, CAST(ts AS DATE) AS day, 'e' || CAST(CAST(regexp_extract(props, '[0-9]+') AS INT) % 8 AS VARCHAR) AS code, ts, event_id
    FROM events WHERE event_type = 'error')"""


def count_of_words() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    click, view, k = F.col("event_type") == "click", F.col("event_type") == "view", count_of_words()
    return e.groupBy(F.col("user_id").alias("install_id"), F.to_date("ts").alias("day")).agg(
        F.count_if(click).alias("dictations"), total(F.when(click, k)).alias("words"), F.count_if(view).alias("meetings"), total(F.when(view, k)).alias("meeting_words"),
        cents(F.coalesce(F.sum(F.when(click, F.col("value"))), F.lit(0.0))).alias("audio_seconds"),
    ).withColumn("seconds_saved", F.round(F.col("words") * F.lit(1.1), 2))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.col("user_id").alias("install_id"), F.to_date("ts").alias("day"), F.concat(F.lit("e"), (count_of_words() % 8).cast("string")).alias("code"), "ts", "event_id")
