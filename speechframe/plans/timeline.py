"""Timeline algebra over events and conversations (W, J5-J9, J12, J14, A12-A16).

A user's events are a timeline: an event starts at its second of January 2024
(scaled down), lasts as long as its value says, and its type is the speaker.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals, sequence
from ..registry import query
from ..session import table

KEY = ["m"]
#: Events as segments: starts on a grid of 0.25 s so that both engines compute the same doubles.
SEG_SQL = """seg AS (SELECT user_id AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_id,
    floor(epoch(ts) - 1704067200) / 4096 AS start, floor(epoch(ts) - 1704067200) / 4096 + (1 + event_id % 9) / 4.0 AS "end",
    event_type AS speaker, CAST(strpos('cepsv', left(event_type, 1)) + CASE event_type WHEN 'signup' THEN 0 ELSE 0 END AS INTEGER) AS label, ' ' || event_type AS word FROM events)"""


def segments(spark, d, dealt: bool = False):
    """dealt: users stay in as many partitions as given, for what makes many rows of a segment."""
    e = table(spark, d, "events")
    e = intervals.dealt(e.select("user_id", "ts", "event_id", "event_type"), "user_id") if dealt else e
    start = F.floor(F.unix_micros("ts") / 1_000_000 - 1704067200).cast("double") / 4096
    return e.select(
        F.col("user_id").alias("m"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"), "event_id", start.alias("start"), (start + (1 + F.col("event_id") % 9) / 4.0).alias("end"),
        F.col("event_type").alias("speaker"), F.instr(F.lit("cepsv"), F.left("event_type", F.lit(1))).alias("label"), F.concat(F.lit(" "), "event_type").alias("word"))


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols or ("start", "end")})


ISLAND = "sum(CASE WHEN {0} THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY start, ord ROWS UNBOUNDED PRECEDING)"


@query("w1_speaker_blocks", f"""WITH {SEG_SQL}, l AS (SELECT *, lag(speaker) OVER (PARTITION BY m ORDER BY start, ord) AS p FROM seg), i AS (SELECT *, {ISLAND.format('p IS NULL OR p <> speaker')} AS island FROM l)
    SELECT m, CAST(island AS BIGINT) AS island, speaker, round(min(start), 6) AS start, round(arg_max("end", ord), 6) AS "end", trim(string_agg(word, '' ORDER BY ord)) AS text FROM i GROUP BY 1, 2, 3""")  # fmt: skip
def w1(spark, d):
    """Runs of a speaker; the end is the last word's."""
    return rounded(sequence.blocks(segments(spark, d), KEY, ["start", "ord"]))


@query("w2_joined_blocks", f"""WITH {SEG_SQL}, l AS (SELECT *, lag(speaker) OVER (PARTITION BY m ORDER BY start, ord) AS p FROM seg), i AS (SELECT *, {ISLAND.format('p IS NULL OR p <> speaker')} AS island FROM l)
    SELECT m, CAST(island AS BIGINT) AS island, speaker, round(min(start), 6) AS start, round(arg_max("end", ord), 6) AS "end", trim(string_agg(trim(word || '  '), ' ' ORDER BY ord)) AS text FROM i GROUP BY 1, 2, 3""")  # fmt: skip
def w2(spark, d):
    """Blocks of text with blanks at both ends, joined with one."""
    b = segments(spark, d).withColumn("word", F.concat("word", F.lit("  ")))
    return rounded(sequence.blocks(b, KEY, ["start", "ord"], between=" "))


@query("w3_speech_units", f"""WITH {SEG_SQL}, l AS (SELECT *, lag("end") OVER (PARTITION BY m ORDER BY start, ord) AS p FROM seg), i AS (SELECT *, {ISLAND.format('p IS NULL OR start - p >= 0.25')} AS island FROM l)
    SELECT m, CAST(island AS BIGINT) AS island, count(*) AS n, round(min(start), 6) AS start, round(max("end"), 6) AS "end" FROM i GROUP BY 1, 2""")  # fmt: skip
def w3(spark, d):
    u = sequence.units(segments(spark, d), KEY, ["start", "ord"])
    return rounded(u.groupBy("m", "island").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end")))


@query("w4_paragraphs", f"""WITH {SEG_SQL}, t AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN '' ELSE speaker END AS text FROM seg), l AS (SELECT *, lag("end") OVER (PARTITION BY m ORDER BY start, ord) AS p FROM t), i AS (SELECT *, {ISLAND.format('start - p > 2.0')} AS s FROM l)
    SELECT m, ord, CAST(dense_rank() OVER (PARTITION BY m ORDER BY s) AS INTEGER) AS island FROM i WHERE text <> ''""")  # fmt: skip
def w4(spark, d):
    t = segments(spark, d).withColumn("text", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("speaker")))
    return sequence.paragraphs(t, KEY, ["start", "ord"]).select("m", "ord", "island")


@query("w5_single_flips", f"""WITH {SEG_SQL}, l AS (SELECT *, lag(speaker) OVER w AS a, lead(speaker) OVER w AS b FROM seg WINDOW w AS (PARTITION BY m ORDER BY start, ord))
    SELECT event_id, CASE WHEN a = b AND speaker <> a THEN a ELSE speaker END AS speaker FROM l""")  # fmt: skip
def w5(spark, d):
    """One flip between equal neighbours."""
    s = segments(spark, d)
    return s.select("event_id", sequence.single_flips(s, KEY, ["start", "ord"], "speaker").alias("speaker"))


@query("w8_merge_close", f"""WITH {SEG_SQL}, l AS (SELECT *, lag(speaker) OVER (PARTITION BY m ORDER BY start, ord) AS p, lag("end") OVER (PARTITION BY m ORDER BY start, ord) AS q FROM seg), i AS (SELECT *, {ISLAND.format('p IS NULL OR p <> speaker OR start - q > 0.5')} AS island FROM l)
    SELECT m, CAST(island AS BIGINT) AS island, speaker, round(min(start), 6) AS start, round(arg_max("end", ord), 6) AS "end" FROM i GROUP BY 1, 2, 3""")  # fmt: skip
def w8(spark, d):
    return rounded(sequence.merge_close(segments(spark, d), KEY))


@query("w10_grid_vote", f"""WITH {SEG_SQL}, z AS (SELECT *, floor((SELECT arg_max(b."end", b.ord) FROM seg b WHERE b.m = seg.m) / 0.5) AS last FROM seg),
    c AS (SELECT m, ord, label, unnest(range(CAST(floor(start / 0.5) AS BIGINT), CAST(least(floor("end" / 0.5), last) AS BIGINT) + 1)) AS cell FROM z),
    v AS (SELECT m, cell, label, count(*) AS n, min(ord) AS f FROM c GROUP BY 1, 2, 3), b AS (SELECT m, cell, arg_max(label, n * 1000000 - f) AS label FROM v GROUP BY 1, 2),
    l AS (SELECT *, lag(label) OVER w AS p, lag(cell) OVER w AS q FROM b WINDOW w AS (PARTITION BY m ORDER BY cell)),
    i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> label OR cell * 0.5 - (q * 0.5 + 0.5) > 0.75 THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY cell ROWS UNBOUNDED PRECEDING) AS island FROM l)
    SELECT m, CAST(island AS BIGINT) AS island, label, round(min(cell) * 0.5, 6)::DOUBLE AS start, round(max(cell) * 0.5 + 0.5, 6)::DOUBLE AS "end" FROM i GROUP BY 1, 2, 3""")  # fmt: skip
def w10(spark, d):
    """A majority a cell, ties to the first seen."""
    return rounded(sequence.grid_vote(segments(spark, d, dealt=True), KEY))


@query("w11_fill_gaps", f"""WITH {SEG_SQL}, l AS (SELECT *, lag("end") OVER w AS a, lead(start) OVER w AS b FROM seg WINDOW w AS (PARTITION BY m ORDER BY start, ord)),
    f AS (SELECT m, ord, speaker, CASE WHEN a IS NULL THEN 0 WHEN start > a THEN (a + start) / 2 ELSE start END AS start, CASE WHEN b IS NULL THEN 1000 WHEN b > "end" THEN ("end" + b) / 2 ELSE "end" END AS "end" FROM l),
    g AS (SELECT *, lag(speaker) OVER (PARTITION BY m ORDER BY start, ord) AS p FROM f), i AS (SELECT *, {ISLAND.format('p IS NULL OR p <> speaker')} AS island FROM g)
    SELECT m, CAST(island AS BIGINT) AS island, speaker, round(min(start), 6) AS start, round(arg_max("end", ord), 6) AS "end" FROM i GROUP BY 1, 2, 3""")  # fmt: skip
def w11(spark, d):
    return rounded(sequence.fill_gaps(segments(spark, d), KEY, F.lit(1000.0)))


@query("w15_link_evidence", f"""WITH {SEG_SQL}, l AS (SELECT m, label, lead(label) OVER w AS b, lead(ord // 3) OVER w = ord // 3 AS same FROM seg WINDOW w AS (PARTITION BY m ORDER BY start, ord))
    SELECT m, least(label, b) AS a, greatest(label, b) AS b, count(*) AS adjacent, count(*) FILTER (WHERE same) AS links, round(count(*) FILTER (WHERE same) / count(*), 6) AS rate FROM l WHERE label <> b GROUP BY 1, 2, 3""")  # fmt: skip
def w15(spark, d):
    s = segments(spark, d).withColumn("seg_id", F.floor(F.col("ord") / 3))
    return sequence.link_evidence(s, KEY).withColumn("rate", F.round("rate", 6))


@query("w16_reassigned", """WITH c AS (SELECT conv_id AS m, turn AS ord, role AS speaker, turn * 8.0 AS start, turn * 8.0 + 6 AS "end", list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM conversations WHERE trim(text) <> ''),
    p AS (SELECT m, ord, unnest(CASE WHEN ord = 1 AND len(w) > 2 THEN [{'i': 0, 's': speaker, 'a': 0, 'b': 2}, {'i': 1, 's': 'guest', 'a': 2, 'b': least(5, len(w))}, {'i': 2, 's': speaker, 'a': least(5, len(w)), 'b': len(w)}] ELSE [{'i': 0, 's': speaker, 'a': 0, 'b': len(w)}] END) AS x, start, "end", w FROM c),
    q AS (SELECT m, ord, x.i AS i, x.s AS speaker, start + ("end" - start) * x.a / len(w) AS start, start + ("end" - start) * x.b / len(w) AS "end", array_to_string(w[CAST(x.a + 1 AS INT):CAST(x.b AS INT)], ' ') AS text FROM p WHERE x.b > x.a),
    l AS (SELECT *, lag(speaker) OVER (PARTITION BY m ORDER BY ord, i) AS prev FROM q), g AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> speaker THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY ord, i ROWS UNBOUNDED PRECEDING) AS island FROM l)
    SELECT m, CAST(island AS BIGINT) AS island, speaker, round(arg_min(start, ord * 10 + i), 6)::DOUBLE AS start, round(arg_max("end", ord * 10 + i), 6)::DOUBLE AS "end", string_agg(text, ' ' ORDER BY ord, i) AS text FROM g GROUP BY 1, 2, 3""")  # fmt: skip
def w16(spark, d):
    b = table(spark, d, "conversations").where("trim(text) <> ''").select(F.col("conv_id").alias("m"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), (F.col("turn") * 8.0).alias("start"), (F.col("turn") * 8.0 + 6).alias("end"), F.array_join(F.filter(F.split("text", r"\s+"), lambda x: x != ""), " ").alias("text"))
    edits = b.where("ord = 1").select("m", "ord", F.lit(2).alias("first"), F.lit(5).alias("last"), F.lit("guest").alias("speaker"))
    return rounded(sequence.reassign(b, KEY, edits))


@query("w20_region_numbers", f"WITH {SEG_SQL} SELECT m, ord AS seg_id, CAST(g - 1 AS INTEGER) AS part, round(start + (\"end\" - start) * (g - 1) / n, 6) AS start FROM (SELECT *, unnest(range(1, n + 1)) AS g FROM (SELECT *, CAST(1 + event_id % 3 AS BIGINT) AS n FROM seg))")
def w20(spark, d):
    s = segments(spark, d).withColumn("n", (1 + F.col("event_id") % 3).cast("int"))
    at = s.select("m", F.col("ord").alias("seg_id"), "start", "end", "n", F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("part", "g"))
    return at.select("m", "seg_id", "part", F.round(F.col("start") + (F.col("end") - F.col("start")) * F.col("part") / F.col("n"), 6).alias("start"))


@query("w21_uncertain", f"""WITH {SEG_SQL}, x AS (SELECT *, (event_id * 13 % 100) / 100.0 AS margin, lag(label) OVER w AS a, lead(label) OVER w AS b FROM seg WINDOW w AS (PARTITION BY m ORDER BY start, ord))
    SELECT event_id, margin < 0.18 OR coalesce(label <> a OR label <> b, label <> a, label <> b, false) OR avg(CASE WHEN margin < 0.18 THEN 1.0 ELSE 0 END) OVER (PARTITION BY m) > 0.2 AS uncertain FROM x""")  # fmt: skip
def w21(spark, d):
    s = segments(spark, d).withColumn("margin", F.col("event_id") * 13 % 100 / 100.0)
    return sequence.uncertain(s, KEY, trip=0.2).select("event_id", "uncertain")


TURN_SQL = """turns AS (SELECT conv_id AS m, turn AS ord, turn * 7.0 AS start, turn * 7.0 + 5 + conv_id % 3 - CASE WHEN turn % 3 = 2 THEN 3.0 ELSE 0.0 END AS "end", role AS speaker, CAST(strpos('asu', left(role, 1)) AS INTEGER) AS label FROM conversations),
    pts AS (SELECT conv_id * 1000 + i AS pid, conv_id AS m, i * 1.25 AS t FROM (SELECT DISTINCT conv_id FROM conversations), range(0, 60) r(i))"""


def turns(spark, d):
    """Every turn; each third ends three seconds sooner, which leaves a gap after it."""
    t, m = F.col("turn"), F.col("conv_id")
    end = t * 7.0 + 5 + m % 3 - F.when(t % 3 == 2, 3.0).otherwise(0.0)
    return table(spark, d, "conversations").select(m.alias("m"), t.alias("ord"), (t * 7.0).alias("start"), end.alias("end"), F.col("role").alias("speaker"), F.instr(F.lit("asu"), F.left("role", F.lit(1))).alias("label"))


def points(spark, d):
    p = intervals.dealt(table(spark, d, "conversations").select("conv_id"), "conv_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(59))))
    return p.select((F.col("conv_id") * 1000 + F.col("i")).alias("pid"), F.col("conv_id").alias("m"), (F.col("i") * 1.25).alias("t"))


@query("j5_j6_nearest_segment", f"""WITH {TURN_SQL}, d AS (SELECT pid, t, speaker, ord, CASE WHEN start <= t AND t <= "end" THEN 0 ELSE 1 END AS miss, CASE WHEN start <= t AND t <= "end" THEN 0 ELSE least(abs(t - start), abs(t - "end")) END AS dist FROM pts JOIN turns USING (m))
    SELECT pid, speaker FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY miss, dist, ord) AS r FROM d) WHERE r = 1""")  # fmt: skip
def j5(spark, d):
    return intervals.nearest_segment(points(spark, d), turns(spark, d), KEY, "t").select("pid", "speaker")


@query("j7_majority_vote", f"""WITH {TURN_SQL}, v AS (SELECT pid, label, count(*) AS n FROM pts JOIN turns USING (m) WHERE start < t + 9 AND "end" > t GROUP BY 1, 2) SELECT pid, arg_max(label, n * 100 - label) AS label FROM v GROUP BY 1""")
def j7(spark, d):
    spans = points(spark, d).select("m", F.col("pid").alias("lid"), F.col("t").alias("start"), (F.col("t") + 9).alias("end"))
    return intervals.majority(spans, turns(spark, d), KEY).withColumnRenamed("lid", "pid")


@query("j8_weighted_vote", f"""WITH {TURN_SQL}, v AS (SELECT pid, label, round(sum(least("end", t + 9) - greatest(start, t)), 9) AS s FROM pts JOIN turns USING (m) WHERE start < t + 9 AND "end" > t GROUP BY 1, 2)
    SELECT pid, arg_max(label, s * 1000 - label) AS label, round(max(s) / sum(s), 6) AS share FROM v GROUP BY 1""")  # fmt: skip
def j8(spark, d):
    spans = points(spark, d).select("m", F.col("pid").alias("lid"), F.col("t").alias("start"), (F.col("t") + 9).alias("end"))
    return intervals.weighted(spans, turns(spark, d), KEY).select(F.col("lid").alias("pid"), "label", F.round("share", 6).alias("share"))


@query("j9_as_of", f"""WITH {TURN_SQL} SELECT pid, coalesce((SELECT arg_max(label, ord) FROM turns b WHERE b.m = p.m AND b.start <= p.t - 3), (SELECT arg_min(label, ord) FROM turns b WHERE b.m = p.m)) AS label FROM pts p""")
def j9(spark, d):
    p = points(spark, d).withColumn("t", F.col("t") - 3)
    return intervals.as_of(p, turns(spark, d), KEY, "t", "label").select("pid", "label")


@query("j12_names", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Marie' WHEN 'assistant' THEN 'Voix 2' ELSE 'Voix 3' END AS label FROM conversations")
def j12(spark, d):
    from ..operators.export import speaker_label

    c = table(spark, d, "conversations")
    names = spark.createDataFrame([("SPEAKER_00", "Marie")], "speaker string, name string")
    s = c.withColumn("speaker", F.concat(F.lit("SPEAKER_0"), F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2).cast("string")))
    return s.join(F.broadcast(names), "speaker", "left").select("conv_id", "turn", speaker_label(F.col("speaker"), F.col("name")).alias("label"))


LEVEL_SQL = "levels AS (SELECT user_id AS m, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS block, event_id % 101 / 100.0 AS mic_rms, event_id % 97 / 96.0 AS sys_rms FROM events)"


@query("j14_w18_by_source", f"""WITH {LEVEL_SQL}, b AS (SELECT conv_id AS m, turn AS ord, conv_id * 1000 + turn AS lid, turn * 0.5 AS start, turn * 0.5 + 0.4 AS "end" FROM conversations),
    x AS (SELECT lid, avg(mic_rms) AS mm, avg(sys_rms) AS ss FROM b JOIN levels l ON l.m = b.m AND l.block >= floor(b.start / 0.05) AND l.block <= greatest(floor(b.start / 0.05), floor(b."end" / 0.05) - 1) GROUP BY 1)
    SELECT lid, CASE WHEN mm > ss THEN 'SPEAKER_00' WHEN mm IS NOT NULL THEN 'SPEAKER_01' ELSE 'SPEAKER_99' END AS speaker FROM b LEFT JOIN x USING (lid)""")  # fmt: skip
def j14(spark, d):
    e = table(spark, d, "events")
    levels = e.select(F.col("user_id").alias("m"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("block"), (F.col("event_id") % 101 / 100.0).alias("mic_rms"), (F.col("event_id") % 97 / 96.0).alias("sys_rms"))
    b = table(spark, d, "conversations").select(F.col("conv_id").alias("m"), (F.col("conv_id") * 1000 + F.col("turn")).alias("lid"), (F.col("turn") * 0.5).alias("start"), (F.col("turn") * 0.5 + 0.4).alias("end"), F.lit("SPEAKER_99").alias("speaker"))
    return intervals.by_source(b, levels, KEY).select("lid", "speaker")


@query("a12_mean_confidence", "SELECT user_id, round_even(coalesce(avg(round_even(p, 3)), 1.0), 3) AS conf FROM (SELECT user_id, (event_id * 7 % 1000) / 1000.0::DOUBLE AS p FROM events) GROUP BY 1")
def a12(spark, d):
    p = table(spark, d, "events").select("user_id", (F.col("event_id") * 7 % 1000 / 1000.0).alias("p"))
    return p.groupBy("user_id").agg(F.bround(F.coalesce(F.avg(F.bround("p", 3)), F.lit(1.0)), 3).alias("conf"))


@query("a14_speaking_time", f"WITH {SEG_SQL} SELECT m, speaker, round(sum(\"end\" - start), 4) AS seconds FROM seg GROUP BY 1, 2")
def a14(spark, d):
    return segments(spark, d).groupBy("m", "speaker").agg(F.round(F.sum(F.col("end") - F.col("start")), 4).alias("seconds"))


@query("a15_weighted_confidence", f"WITH {SEG_SQL} SELECT m, round(sum(((event_id * 7) % 100) / 100.0 * (\"end\" - start)) / sum(\"end\" - start), 4) AS conf FROM seg GROUP BY 1")
def a15(spark, d):
    dur, share = F.col("end") - F.col("start"), F.col("event_id") * 7 % 100 / 100.0
    return segments(spark, d).groupBy("m").agg(F.round(F.sum(share * dur) / F.sum(dur), 4).alias("conf"))


@query("a16_participants", "SELECT conv_id, count(DISTINCT role) AS speakers, string_agg(role, ',' ORDER BY f) AS participants FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2) GROUP BY 1")
def a16(spark, d):
    first = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("f"))
    return first.groupBy("conv_id").agg(F.count("*").alias("speakers"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", "role"))), lambda x: x.role), ",").alias("participants"))


@query("f27_shifted_words", f"WITH {SEG_SQL} SELECT event_id, round(start + 25, 6) AS start, round_even((event_id * 7 % 9973) / 9973.0::DOUBLE, 3) AS prob FROM seg")
def f27(spark, d):
    """Times of a window's words are shifted by its offset; missing ones take the segment's."""
    return segments(spark, d).select("event_id", F.round(F.coalesce(F.col("start"), F.lit(0.0)) + 25, 6).alias("start"), F.bround(F.col("event_id") * 7 % 9973 / 9973.0, 3).alias("prob"))
