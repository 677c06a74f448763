"""Usage analytics: counters, month and total roll-ups, incidents, the install overview (A, F1-F3, J1-J3, P2-P5)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import upsert
from ..registry import query
from ..session import cents, table, total
from .readings import INCIDENTS_SQL, TODAY, USAGE_SQL, incidents, usage

COUNTERS = ["dictations", "words", "meetings", "meeting_words"]
SECONDS = ["audio_seconds", "seconds_saved"]
WITH = f"WITH {USAGE_SQL} "
SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in COUNTERS)
SUM_S = ", ".join(f"round(coalesce(sum({c}), 0), 2) AS {c}" for c in SECONDS)


def sums(prefix: str = "") -> list:
    return [total(c).alias(prefix + c) for c in COUNTERS] + [cents(F.coalesce(F.sum(c), F.lit(0.0))).alias(prefix + c) for c in SECONDS]


@query("a1_totals", f"{WITH} SELECT {SUMS}, {SUM_S}, CAST(sum(words + meeting_words) AS BIGINT) AS total_words FROM usage")
def a1(spark, d):
    return usage(spark, d).agg(*sums(), total(F.col("words") + F.col("meeting_words")).alias("total_words"))


@query("a2_month_to_date", f"{WITH} SELECT {SUMS}, {SUM_S} FROM usage WHERE day >= date_trunc('month', DATE '{TODAY}')")
def a2(spark, d):
    return usage(spark, d).where(F.col("day") >= F.trunc(F.lit(TODAY).cast("date"), "MM")).agg(*sums())


@query("a2_totals_and_month", f"{WITH} SELECT CAST(sum(words) AS BIGINT) AS words_total, CAST(sum(words) FILTER (WHERE day >= DATE '{TODAY[:8]}15') AS BIGINT) AS words_window FROM usage")
def a2b(spark, d):
    """Two windows of time in one scan."""
    return usage(spark, d).agg(total("words").alias("words_total"), total(F.when(F.col("day") >= F.lit(f"{TODAY[:8]}15").cast("date"), F.col("words"))).alias("words_window"))


@query("a3_daily_series", f"{WITH} SELECT day, {SUMS}, {SUM_S} FROM usage WHERE day >= DATE '{TODAY}' - 20 GROUP BY day")
def a3(spark, d):
    return usage(spark, d).where(F.col("day") >= F.date_sub(F.lit(TODAY).cast("date"), 20)).groupBy("day").agg(*sums()).orderBy("day")


@query("a4_since_day", f"{WITH} SELECT min(day) AS since_day FROM usage")
def a4(spark, d):
    return usage(spark, d).agg(F.min("day").alias("since_day"))


@query("a5_lifetime", f"{WITH} SELECT install_id, CAST(sum(dictations) AS BIGINT) AS dictations, CAST(sum(words) AS BIGINT) AS words, round(sum(seconds_saved), 2) AS seconds_saved FROM usage GROUP BY 1")
def a5(spark, d):
    return usage(spark, d).groupBy("install_id").agg(total("dictations").alias("dictations"), total("words").alias("words"), cents(F.sum("seconds_saved")).alias("seconds_saved"))


SPLIT = "2024-01-16"


@query("a6_backfill", f"""{WITH}, counted AS (SELECT day, CAST(sum(dictations) AS BIGINT) AS dictations, CAST(sum(words) AS BIGINT) AS words FROM usage WHERE day >= DATE '{SPLIT}' GROUP BY 1),
    history AS (SELECT day, CAST(sum(dictations) AS BIGINT) AS dictations, CAST(sum(words) AS BIGINT) AS words FROM usage WHERE day < DATE '{SPLIT}' + 3 GROUP BY 1)
    SELECT * FROM counted UNION ALL SELECT * FROM history WHERE day < (SELECT min(day) FROM counted)""")  # fmt: skip
def a6(spark, d):
    days = usage(spark, d).groupBy("day").agg(total("dictations").alias("dictations"), total("words").alias("words"))
    counted, history = days.where(F.col("day") >= F.lit(SPLIT).cast("date")), days.where(F.col("day") < F.date_add(F.lit(SPLIT).cast("date"), 3))
    return upsert.backfill(counted, history, "day", ["dictations", "words"])


def overview(installs, used, today: str = TODAY):
    """A row per install, with or without usage, which has one row per install and day (its key): rolled up before the join, so one row a key is shuffled and no distinct count is needed."""
    month = F.col("day") >= F.trunc(F.lit(today).cast("date"), "MM")
    active = (F.col("dictations") > 0) | (F.col("meetings") > 0)
    rolled = used.groupBy("install_id").agg(
        total("dictations").alias("dictations_total"), total("words").alias("words_total"), F.sum("seconds_saved").alias("seconds_saved_total"), F.sum("audio_seconds").alias("audio_seconds_total"),
        total("meetings").alias("meetings_total"), total("meeting_words").alias("meeting_words_total"), F.sum(F.when(month, F.col("seconds_saved"))).alias("seconds_saved_month"),
        total(F.when(month, F.col("words"))).alias("words_month"), F.count_if(active).alias("active_days"), F.min("day").alias("first_usage_day"), F.max("day").alias("last_usage_day"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("dictations_total", "words_total", "meetings_total", "meeting_words_total", "words_month", "active_days")}
    zero |= {c: cents(F.coalesce(c, F.lit(0.0))) for c in ("seconds_saved_total", "audio_seconds_total", "seconds_saved_month")}
    return installs.join(rolled, "install_id", "left").withColumns(zero)


@query("a7_install_overview", f"""{WITH} SELECT i.c_custkey AS install_id, i.c_name AS first_name,
        CAST(coalesce(sum(u.dictations), 0) AS BIGINT) AS dictations_total, CAST(coalesce(sum(u.words), 0) AS BIGINT) AS words_total,
        round(coalesce(sum(u.seconds_saved), 0), 2) AS seconds_saved_total, round(coalesce(sum(u.audio_seconds), 0), 2) AS audio_seconds_total,
        CAST(coalesce(sum(u.meetings), 0) AS BIGINT) AS meetings_total, CAST(coalesce(sum(u.meeting_words), 0) AS BIGINT) AS meeting_words_total,
        round(coalesce(sum(u.seconds_saved) FILTER (WHERE u.day >= date_trunc('month', DATE '{TODAY}')), 0), 2) AS seconds_saved_month,
        CAST(coalesce(sum(u.words) FILTER (WHERE u.day >= date_trunc('month', DATE '{TODAY}')), 0) AS BIGINT) AS words_month,
        CAST(count(DISTINCT u.day) FILTER (WHERE u.dictations > 0 OR u.meetings > 0) AS BIGINT) AS active_days, min(u.day) AS first_usage_day, max(u.day) AS last_usage_day
    FROM customer i LEFT JOIN usage u ON u.install_id = i.c_custkey GROUP BY 1, 2""")  # fmt: skip
def a7(spark, d):
    installs = table(spark, d, "customer").select(F.col("c_custkey").alias("install_id"), F.col("c_name").alias("first_name"))
    return overview(installs, usage(spark, d))


@query("j1_left_join_rollup", f"{WITH} SELECT c.c_custkey AS install_id, CAST(count(u.day) AS BIGINT) AS days, CAST(coalesce(sum(u.words), 0) AS BIGINT) AS words FROM customer c LEFT JOIN usage u ON u.install_id = c.c_custkey GROUP BY 1")
def j1(spark, d):
    rolled = usage(spark, d).groupBy("install_id").agg(F.count("day").alias("days"), total("words").alias("words"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("install_id")).join(rolled, "install_id", "left").na.fill(0)


@query("j2_fk_violations", "SELECT 'valid' AS state, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') UNION ALL SELECT 'orphan', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def j2(spark, d):
    """Rows whose parent exists, and those a cascading delete of a segment's customers takes."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    key = F.col("o_custkey") == F.col("c_custkey")
    return o.join(c, key, "left_semi").select(F.lit("valid").alias("state")).unionByName(o.join(c, key, "left_anti").select(F.lit("orphan").alias("state"))).groupBy("state").agg(F.count("*").alias("n"))


@query("j3_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey)")
def j3(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "events"), F.col("c_custkey") == F.col("user_id"), "left_anti")


@query("a8_incident_counts", f"WITH {INCIDENTS_SQL} SELECT day, code, count(*) AS n FROM incidents GROUP BY 1, 2 ORDER BY day, code LIMIT 200")
def a8(spark, d):
    """The oldest 200, as the limit follows an ascending sort."""
    return incidents(spark, d).groupBy("day", "code").agg(F.count("*").alias("n")).orderBy("day", "code").limit(200)


@query("a9_summary_by_code", f"WITH {INCIDENTS_SQL} SELECT code, count(*) AS n FROM (SELECT * FROM incidents ORDER BY ts DESC, event_id DESC LIMIT 4000) GROUP BY 1")
def a9(spark, d):
    return incidents(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(4000).groupBy("code").agg(F.count("*").alias("n"))


@query("a10_capped_count", "SELECT count(*) AS n FROM (SELECT 1 FROM orders LIMIT 9999)")
def a10(spark, d):
    return table(spark, d, "orders").limit(9999).agg(F.count("*").alias("n"))


@query("a17_report_rows", f"{WITH} SELECT install_id, day, dictations, words, round_even(seconds_saved, 1) AS seconds_saved, round_even(audio_seconds, 1) AS audio_seconds FROM usage WHERE day >= DATE '{TODAY}' - 31")
def a17(spark, d):
    """Rows as they are sent: one decimal, half to even, nothing null."""
    one = lambda c: F.bround(F.coalesce(c, F.lit(0.0)), 1)
    return usage(spark, d).where(F.col("day") >= F.date_sub(F.lit(TODAY).cast("date"), 31)).select("install_id", "day", "dictations", "words", one("seconds_saved").alias("seconds_saved"), one("audio_seconds").alias("audio_seconds"))


@query("a18_strikes", f"""WITH {INCIDENTS_SQL}, w AS (SELECT event_id, install_id, (SELECT count(*) FROM incidents b WHERE b.install_id = a.install_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 24 HOUR) AS recent FROM incidents a)
    SELECT event_id, install_id, recent, CASE WHEN recent >= 3 THEN 'permanent' ELSE 'suspended' END AS action FROM w""")  # fmt: skip
def a18(spark, d):
    return upsert.strikes(incidents(spark, d), "install_id", "ts", 3, 86_400).select("event_id", "install_id", "recent", "action")


@query("p2_from_day", f"{WITH} SELECT install_id, day, words FROM usage WHERE day >= DATE '2024-01-20'")
def p2(spark, d):
    return usage(spark, d).where(F.col("day") >= F.lit("2024-01-20").cast("date")).select("install_id", "day", "words")


@query("p3_coalesced_sums", f"{WITH} SELECT CAST(coalesce(sum(words), 0) AS BIGINT) AS words, CAST(coalesce(sum(dictations), 0) AS BIGINT) AS dictations FROM usage WHERE day > DATE '2030-01-01'")
def p3(spark, d):
    return usage(spark, d).where(F.col("day") > F.lit("2030-01-01").cast("date")).agg(total("words").alias("words"), total("dictations").alias("dictations"))


@query("p4_total_words", f"{WITH} SELECT install_id, day, words + meeting_words AS total_words FROM usage")
def p4(spark, d):
    return usage(spark, d).select("install_id", "day", (F.col("words") + F.col("meeting_words")).alias("total_words"))


@query("p5_clamped", "SELECT event_id, CAST(least(50, greatest(0, coalesce(CAST(regexp_extract(props, '[0-9]+') AS INT), 0))) AS INTEGER) AS k, least(100.0, greatest(0.0, coalesce(value, 0)))::DOUBLE AS value FROM events")
def p5(spark, d):
    clamp = lambda c, hi: F.least(F.lit(hi), F.greatest(F.lit(type(hi)(0)), F.coalesce(c, F.lit(type(hi)(0)))))
    return table(spark, d, "events").select("event_id", clamp(F.get_json_object("props", "$.k").try_cast("int"), 50).alias("k"), clamp(F.col("value"), 100.0).alias("value"))


@query("f1_local_day", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def f1(spark, d):
    """Epoch seconds to the session's day."""
    return table(spark, d, "events").select("event_id", F.to_date(F.timestamp_seconds(F.unix_micros("ts") / 1e6)).alias("day"))


@query("f2_month_start", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def f2(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.trunc("o_orderdate", "MM").alias("month"))


@query("f3_days_back", "SELECT o_orderkey, CAST(o_orderdate - INTERVAL 31 DAY AS DATE) AS since FROM orders")
def f3(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_sub("o_orderdate", 31).alias("since"))


@query("t18_seconds_saved", f"{WITH} SELECT install_id, day, round(words * (60.0 / 40 - 60.0 / 150), 2)::DOUBLE AS saved FROM usage")
def t18(spark, d):
    return usage(spark, d).select("install_id", "day", F.round(F.col("words") * F.lit(60 / 40 - 60 / 150), 2).alias("saved"))


@query("f13_budgets", "SELECT event_id, round(22 + 0.5 * greatest(0, value), 4)::DOUBLE AS inference, round(greatest(30.0, 22 + 0.5 * greatest(0, value) + 3), 4)::DOUBLE AS finalise, round(greatest(0.3, least(0.8, (value - 12) / 45 + 0.3)), 4)::DOUBLE AS pace FROM events")
def f13(spark, d):
    """time budgets and the pacing ramp."""
    v = F.col("value")
    inference = 22 + 0.5 * F.greatest(F.lit(0.0), v)
    return table(spark, d, "events").select("event_id", F.round(inference, 4).alias("inference"), F.round(F.greatest(F.lit(30.0), inference + 3), 4).alias("finalise"), F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.8), (v - 12) / 45 + 0.3)), 4).alias("pace"))


@query("a11_file_sizes", None)
def a11(spark, d):
    """Number and size of a table's files, from the listing alone (contents aren't read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{d}/documents.parquet")
    return files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("x12_idempotent_replay", f"{WITH} SELECT install_id, day, words, audio_seconds FROM usage")
def x12(spark, d):
    """The last 31 days sent again replace what is there: twice is once."""
    u = usage(spark, d).select("install_id", "day", "words", "audio_seconds")
    rules = {"words": "replace", "audio_seconds": "greatest"}
    replay = u.where(F.col("day") >= F.date_sub(F.lit(TODAY).cast("date"), 31))
    return upsert.merge(upsert.merge(u, replay, ["install_id", "day"], rules), replay, ["install_id", "day"], rules)


@query("w_first_used", f"{WITH} SELECT install_id, min(day) AS first_day, CAST(count(*) AS BIGINT) AS days FROM usage GROUP BY 1")
def w_first(spark, d):
    w = Window.partitionBy("install_id").orderBy("day")
    u = usage(spark, d).withColumn("rn", F.row_number().over(w)).withColumn("days", F.count("*").over(Window.partitionBy("install_id")))
    return u.where("rn = 1").select("install_id", F.col("day").alias("first_day"), "days")
