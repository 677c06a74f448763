"""Streaming operators over events, run to the end of what is there (X)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..registry import query
from ..session import table
from ..storage import scratch
from ..streaming import operators as ops
from ..streaming import queues, stateful
from .speech import CUTS_SQL, WINDOWS_SQL

BOOL = "CAST(ts AS DATE)"


def stream(spark, d):
    """Events as a stream of files, with instants for event time. A source of files takes a folder, or the one file by a pattern that matches its name alone."""
    raw = spark.read.parquet(f"{d}/events.parquet").schema
    try:
        spark.read.schema("content binary").format("binaryFile").load(f"{d}/events.parquet/*.parquet")
        path = f"{d}/events.parquet"
    except AnalysisException:
        path = f"{d}/events.parquet*"
    s = spark.readStream.schema(raw).option("pathGlobFilter", "*.parquet").parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def run(spark, df, schema, mode: str = "append"):
    """The rows a stream emits, as a table."""
    out = scratch(spark, "stream")

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    ops.drain(df, sink, f"{out}/state", mode)
    return spark.read.schema(schema).parquet(f"{out}/rows/*")


@query("x14_suppressed_repeats", """WITH l AS (SELECT user_id, event_type, list({'t': epoch_us(ts), 'e': event_id} ORDER BY ts, event_id) AS l FROM events GROUP BY 1, 2),
    k AS (SELECT user_id, event_type, list_reduce(l, lambda a, x: IF(len(a.k) = 0 OR x.t >= a.t + 43200000000, {'t': x.t, 'k': list_append(a.k, x.e)}, a), {'t': 0::BIGINT, 'k': CAST([] AS BIGINT[])}).k AS k FROM l)
    SELECT user_id, event_type, e.event_id, epoch_us(e.ts) AS at_us FROM (SELECT user_id, event_type, unnest(k) AS event_id FROM k) JOIN events e USING (user_id, event_type, event_id)""")  # fmt: skip
def x14(spark, d):
    s = ops.suppress_repeats(stream(spark, d), "user_id", "event_type", "ts", 43_200.0)
    return run(spark, s, s.schema).select("user_id", "event_type", "event_id", F.unix_micros("ts").alias("at_us"))


@query("x13_due_reminders", """WITH t AS (SELECT user_id AS task_id, event_id AS ord, ts, event_type = 'error' AS opens, CASE WHEN event_type = 'error' THEN ts + INTERVAL 1 DAY END AS due FROM events WHERE event_type IN ('error', 'purchase')),
    n AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 MICROSECOND AS now FROM t),
    s AS (SELECT task_id, ts, ord, opens, last_value(due IGNORE NULLS) OVER w AS due, lead(ts) OVER w AS later, now FROM t, n WHERE ts <= now WINDOW w AS (PARTITION BY task_id ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    c AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, ord) AS k FROM s WHERE opens AND greatest(due, ts) <= least(coalesce(later, now), now))
    SELECT task_id, epoch_us(due) / 1000000.0 AS due FROM c WHERE k = 1""")  # fmt: skip
def x13(spark, d):
    """An error opens a task due a day later, or puts its time off; a purchase closes it."""
    e = stream(spark, d).where("event_type in ('error', 'purchase')")
    due = F.when(F.col("event_type") == "error", F.col("ts") + F.expr("interval 1 day"))
    tasks = e.select(F.col("user_id").alias("task_id"), F.when(F.col("event_type") == "purchase", "done").otherwise("open").alias("status"), due.alias("due"), "ts", F.col("event_id").alias("ord"))
    s = stateful.due_reminders(tasks)
    with stateful.timers(spark):
        return run(spark, s, s.schema)


def level_stream(spark, d, parts: int = 3):
    """Every user's levels (m, frame, rms) and number of frames, as a stream that comes in several files, not in their order."""
    from .speech import levels

    rows = levels(spark, d)
    ends = rows.groupBy("m").agg(F.count("*").alias("frame")).withColumn("rms", F.lit(None).cast("double"))
    out = scratch(spark, "levels")
    both = rows.unionByName(ends)
    both.withColumn("part", F.pmod(F.xxhash64("m", F.floor(F.col("frame") / 40)), F.lit(parts)).cast("int")).repartition(parts, "part").write.option("maxRecordsPerFile", 0).partitionBy("part").parquet(out)
    return spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(out)


@query("x1_streamed_windows", WINDOWS_SQL)
def x1(spark, d):
    """X1 while the recordings grow: windows come as soon as they can be told, the same as of whole recordings."""
    s = stateful.cut_stream(level_stream(spark, d), lambda: stateful.WindowCutter(step=1.0))
    with stateful.timers(spark):
        return run(spark, s, s.schema)


@query("x3_streamed_cuts", CUTS_SQL)
def x3(spark, d):
    s = stateful.cut_stream(level_stream(spark, d), lambda: stateful.TailCutter(step=1.0, target=10.0, run=2, quiet=0.03))
    with stateful.timers(spark):
        return run(spark, s, s.schema).select("m", F.col("first").alias("cut"))


@query("x4_tiles", """WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 / 4096.0 AS t, value FROM events), w AS (SELECT user_id, unnest([floor(t) - 1, floor(t)]) AS start, value FROM e),
    g AS (SELECT user_id, start, sqrt(avg(value * value)) AS rms, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT user_id, CAST(start AS BIGINT) AS start, round(rms, 6) AS rms, n FROM g WHERE round(rms, 6) > 0.008 AND start + 2 <= (SELECT floor(max(t) * 1000) / 1000 - 10 FROM e)""")
def x4(spark, d):
    e = stream(spark, d).select("user_id", F.timestamp_seconds(F.unix_timestamp("ts") / 4096).alias("ts"), "value")
    t = ops.tiles(e, "user_id", "ts", "value", "10 seconds")
    s = t.select("user_id", F.unix_timestamp("t.start").alias("start"), F.round(F.sqrt("square"), 6).alias("rms"), "n").where("rms > 0.008")
    return run(spark, s, s.schema)


@query("x5_x10_drained", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def x5(spark, d):
    """What is left is drained at the end, in the order of arrival; totals equal the batch's."""
    rows = run(spark, stream(spark, d).select("user_id", "event_id", "value"), "user_id long, event_id long, value double")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("x8_aligned_streams", """WITH e AS (SELECT user_id AS key, epoch_us(ts) // 3600000000 AS slot, ts, value AS x, event_type FROM events),
    n AS (SELECT date_trunc('millisecond', least(max(ts) FILTER (WHERE event_type = 'click'), max(ts) FILTER (WHERE event_type = 'view'))) - INTERVAL 1 HOUR AS now FROM e)
    SELECT m.key, m.slot, m.ts, m.x AS mic, coalesce(s.x, 0) AS sys FROM e m CROSS JOIN n LEFT JOIN e s ON s.event_type = 'view' AND s.key = m.key AND s.slot = m.slot
    WHERE m.event_type = 'click' AND (s.key IS NOT NULL OR m.ts + INTERVAL 1 HOUR < now)""")  # fmt: skip
def x8(spark, d):
    e = stream(spark, d)
    part = lambda kind: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.floor(F.unix_timestamp("ts") / 3600).alias("slot"), "ts", F.col("value").alias("x"))
    s = ops.aligned(part("click"), part("view"), "ts", "1 hour")
    return run(spark, s, s.schema)


def queue_sql(put: str, items: str, given_up: str = "a.q", most: str = "true") -> str:
    """A user's rows in order, folded by ``list_reduce``: ``put`` is the queue after an item came, ``items`` the order of service, ``given_up`` the queue without what waited too long."""
    return f"""WITH n AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 MICROSECOND AS now FROM events),
    l AS (SELECT user_id, list({{'take': event_type = 'purchase', 'x': {{'p': CASE event_type WHEN 'error' THEN 0 ELSE 1 END, 't': epoch_us(ts), 'e': event_id}}}} ORDER BY ts, event_id) AS l FROM events, n WHERE ts <= now GROUP BY 1),
    s AS (SELECT user_id, list_reduce(list_transform(l, lambda r: {{'r': r, 'q': CAST([] AS STRUCT(p INTEGER, t BIGINT, e BIGINT)[]), 'd': 0::BIGINT, 'g': 0::BIGINT, 'o': CAST([] AS STRUCT(e BIGINT, item BIGINT, waited DOUBLE, d BIGINT, g BIGINT)[])}}),
        lambda a, r: list_transform([{{'q': {given_up}, 'r': r.r}}], lambda k: CASE
            WHEN k.r.take THEN {{'r': k.r, 'q': ({items})[2:], 'd': a.d, 'g': a.g + len(a.q) - len(k.q), 'o': list_append(a.o, {{'e': k.r.x.e, 'item': ({items})[1].e, 'waited': (k.r.x.t - ({items})[1].t) / 1e6::DOUBLE, 'd': a.d, 'g': a.g + len(a.q) - len(k.q)}})}}
            ELSE {{'r': k.r, 'q': {put}, 'd': a.d + CASE WHEN {most} THEN 0 ELSE 1 END, 'g': a.g + len(a.q) - len(k.q), 'o': a.o}} END)[1], {START}).o AS o FROM l)
    SELECT user_id, o.e AS event_id, o.item AS item, round(o.waited, 6) AS waited, o.d AS dropped, o.g AS expired FROM (SELECT user_id, unnest(o) AS o FROM s)"""


START = "{'r': NULL, 'q': CAST([] AS STRUCT(p INTEGER, t BIGINT, e BIGINT)[]), 'd': 0::BIGINT, 'g': 0::BIGINT, 'o': CAST([] AS STRUCT(e BIGINT, item BIGINT, waited DOUBLE, d BIGINT, g BIGINT)[])}"


def queue(spark, d, **rules):
    """Purchases take what a user's other events put; errors go first where priority counts."""
    e = stream(spark, d)
    rows = e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("ord"), (F.col("event_type") == "purchase").alias("take"), rules.pop("priority", F.lit(1)).alias("priority"))
    s = queues.served(rows, **rules)
    with stateful.timers(spark):
        got = run(spark, s, s.schema)
    return got.select(F.col("key").alias("user_id"), F.col("ord").alias("event_id"), "item", F.round("waited", 6).alias("waited"), "dropped", "expired")


@query("x6_streamed_queue", queue_sql("CASE WHEN len(k.q) < 3 THEN list_append(k.q, k.r.x) ELSE k.q END", "k.q", most="len(k.q) < 3"))
def x6(spark, d):
    """X6 as a stream: a queue of three, the newcomer is dropped and counted."""
    return queue(spark, d, most=3)


@query("x7_streamed_ring", queue_sql("list_append(k.q, k.r.x)[-3:]", "k.q", most="len(k.q) < 3"))
def x7(spark, d):
    """X7 as a stream: a ring of three, the oldest makes room."""
    return queue(spark, d, most=3, drop="oldest")


@query("x9_streamed_jobs", queue_sql("list_append(k.q, k.r.x)", "list_sort(k.q)", given_up="list_filter(a.q, lambda y: r.r.x.t - y.t <= 432000000000)"))
def x9(spark, d):
    """X9 as a stream: errors before all else, first come first served; what has waited five days is given up, which isn't the worker's fault."""
    return queue(spark, d, priority=F.when(F.col("event_type") == "error", 0).otherwise(1), patience=432_000.0)


@query("x11_periodic_flush", f"SELECT {BOOL} AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x11(spark, d):
    """Counters flushed by trigger; the last state of each is what counts."""
    agg = stream(spark, d).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    rows = run(spark, agg, agg.schema, "update")
    return rows.groupBy("day", "event_type").agg(F.max("n").alias("n"))


@query("x18_gated_send", "SELECT user_id, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def x18(spark, d):
    """Only consenting installs' rows reach the sink."""
    e = stream(spark, d).withColumn("consent", F.when(F.col("user_id") % 2 == 0, True)).where(F.col("consent").eqNullSafe(True)).select("user_id", "event_id")
    return run(spark, e, "user_id long, event_id long").groupBy("user_id").agg(F.count("*").alias("n"))
