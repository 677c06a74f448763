"""The report procedure end to end, queue disciplines and sessions (2.13, X6, X7, X9, X15, X16)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import report
from ..registry import query
from ..session import table
from .readings import INCIDENTS_SQL, TODAY, USAGE_SQL, incidents, usage

ID = "lpad(CAST(install_id AS VARCHAR), 8, '0')"


def reported(spark, d):
    """Every install reports all its days as JSON; one in five has no mail."""
    key = F.lpad(F.col("install_id").cast("string"), 8, "0")
    u = usage(spark, d).groupBy("install_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("day", "dictations", "words", "meetings", "seconds_saved", "audio_seconds"))), lambda x: x)).alias("usage"))
    i = incidents(spark, d).groupBy("install_id", "day", "code").agg(F.count("*").alias("count")).groupBy("install_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("day", "code", "count")))).alias("incidents"))
    mail = F.when(F.col("install_id") % 5 != 0, F.concat(F.lit("U"), F.col("install_id"), F.lit("@Example.org ")))
    return u.join(i, "install_id", "full").select(key.alias("install_id"), F.lit(1).alias("seq"), F.lit(f"{TODAY} 12:00:00").cast("timestamp").alias("at"), F.concat(F.lit("Name\t"), F.col("install_id")).alias("first_name"), mail.alias("email"), "usage", "incidents")


def stored(spark, d):
    r = reported(spark, d)
    return report.apply_report(r.limit(0).select("install_id", "first_name", "email", "at"), usage(spark, d).limit(0).withColumn("install_id", F.lit("").cast("string")), incidents(spark, d).limit(0).select(F.lit("").alias("install_id"), "day", "code", F.lit(0).alias("count")), r)


@query("rpc_installs", f"WITH i AS (SELECT DISTINCT user_id AS install_id FROM events WHERE event_type IN ('click', 'view', 'error')) SELECT {ID} AS install_id, 'Name ' || install_id AS first_name, CASE WHEN install_id % 5 = 0 THEN '' ELSE 'u' || install_id || '@example.org' END AS email FROM i")
def installs(spark, d):
    return stored(spark, d)[0].select("install_id", "first_name", "email")


@query("rpc_usage", f"WITH {USAGE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY install_id ORDER BY day) AS n FROM usage) SELECT {ID} AS install_id, day, CAST(dictations AS INTEGER) AS dictations, CAST(words AS INTEGER) AS words, audio_seconds FROM r WHERE n <= 31")
def used(spark, d):
    return stored(spark, d)[1].select("install_id", "day", F.col("dictations").cast("int").alias("dictations"), F.col("words").cast("int").alias("words"), "audio_seconds")


@query("rpc_incidents", f"WITH {INCIDENTS_SQL}, c AS (SELECT install_id, day, code, count(*) AS count FROM incidents GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY install_id ORDER BY day, code) AS n FROM c) SELECT {ID} AS install_id, day, code, CAST(count AS INTEGER) AS count FROM r WHERE n <= 200")
def told(spark, d):
    return stored(spark, d)[2].select("install_id", "day", "code", F.col("count").cast("int").alias("count"))


@query("x6_bounded_queue", "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) SELECT user_id, count(*) FILTER (WHERE n <= 2) AS kept, count(*) FILTER (WHERE n > 2) AS dropped FROM r GROUP BY 1")
def x6(spark, d):
    """A day's queue holds two; what comes later is dropped and counted."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    n = table(spark, d, "events").withColumn("n", F.row_number().over(w))
    return n.groupBy("user_id").agg(F.count_if(F.col("n") <= 2).alias("kept"), F.count_if(F.col("n") > 2).alias("dropped"))


@query("x7_ring_buffer", "SELECT event_id, user_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last FROM events) WHERE ts > last - INTERVAL 36 HOUR")
def x7(spark, d):
    """Only the newest 36 hours of a stream stay: the oldest are dropped."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.join(last, "user_id").where("ts > last - interval 36 hours").select("event_id", "user_id")


@query("x9_priority_order", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'click' THEN 0 ELSE 1 END, ts, event_id) AS INTEGER) AS place FROM events")
def x9(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.when(F.col("event_type") == "click", 0).otherwise(1), "ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.row_number().over(w).alias("place"))


@query("x15_session_gaps", """WITH l AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM l)
    SELECT user_id, min(ts) AS first, count(*) AS beats FROM s GROUP BY user_id, k""")  # fmt: skip
def x15(spark, d):
    """Supervision by silence: a session ends after twelve hours without a beat."""
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.min("ts").alias("first"), F.count("*").alias("beats"))
    return s.select("user_id", "first", "beats")


@query("x16_snapshots", "SELECT user_id, CAST(ts AS DATE) AS day, max(event_id) AS position, count(*) AS n FROM events GROUP BY 1, 2")
def x16(spark, d):
    """The published position and count of each day's stream."""
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("event_id").alias("position"), F.count("*").alias("n"))
