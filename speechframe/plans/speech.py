"""Rules that see their own output, transcript pipelines and reminders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import reminders, text
from ..operators import clusters, folds, intervals, sequence
from ..registry import query
from ..session import table
from .text import BOILERPLATE_SQL, TIDY_SQL, replaced_sql, without_repeats_sql
from .timeline import ISLAND, KEY, SEG_SQL, TURN_SQL, turns, segments


def words(spark, d):
    """Tokens of conversations: 0.4 s a token, 0.05 s apart; the speaker is that of the turn, now and then of the one before."""
    toks = text.words(F.col("text"))
    w = table(spark, d, "conversations").select(F.col("conv_id").alias("m"), "turn", "role", F.posexplode(toks).alias("i", "tok"))
    n = F.row_number().over(Window.partitionBy("m").orderBy("turn", "i"))
    at = w.withColumn("ord", n.cast("long")).withColumn("start", F.col("ord") * 0.45 + F.col("turn") * 1.0)
    slip = (F.col("i") == 0) & (F.col("turn") % 2 == 1)
    return at.select("m", "ord", F.concat(F.lit(" "), "tok").alias("word"), "start", (F.col("start") + 0.4).alias("end"), F.when(slip, "user").otherwise(F.col("role")).alias("speaker"))


#: words as SQL, a row a token.
WORDS_SQL = """tok AS (SELECT conv_id AS m, turn, role, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations),
    flat AS (SELECT m, turn, role, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS i FROM tok), num AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY turn, i) AS ord FROM flat),
    words AS (SELECT m, ord, ' ' || tok AS word, ord * 0.45::DOUBLE + turn * 1.0::DOUBLE AS start, ord * 0.45::DOUBLE + turn * 1.0::DOUBLE + 0.4::DOUBLE AS "end", CASE WHEN i = 0 AND turn % 2 = 1 THEN 'user' ELSE role END AS speaker FROM num)"""


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("start", "end")})


#: Each short segment looks left or right; what stands on the left is as it was decided.
ABSORBED_SQL = f"""{SEG_SQL}, side AS (SELECT *, "end" - start AS len, lag("end" - start) OVER o AS a, lead("end" - start) OVER o AS b, lead(speaker) OVER o AS after FROM seg WINDOW o AS (PARTITION BY m ORDER BY start, ord)),
    pick AS (SELECT *, CASE WHEN len >= 1 OR a IS NULL AND b IS NULL THEN speaker WHEN a IS NULL OR b > a THEN after END AS taken FROM side),
    folded AS (SELECT m, list(ord ORDER BY start, ord) AS ords, list_reduce(list({{'taken': taken, 'l': [taken]}} ORDER BY start, ord), lambda x, y: {{'taken': y.taken, 'l': list_append(x.l, coalesce(y.taken, x.l[-1]))}}).l AS l FROM pick GROUP BY 1),
    absorbed AS (SELECT m, unnest(ords) AS ord, unnest(l) AS speaker FROM folded)"""


@query("w7_absorbed", f"WITH {ABSORBED_SQL} SELECT m, ord, speaker FROM absorbed")
def w7(spark, d):
    def f(p: pd.DataFrame) -> pd.DataFrame:
        return p[["ord"]].assign(speaker=folds.absorb_short(p["start"].to_numpy(), p["end"].to_numpy(), p["speaker"].tolist()))

    return folds.fold(segments(spark, d).select("m", "ord", "start", "end", "speaker"), "m", ["start", "ord"], f, "m long, ord long, speaker string")


FLIPS_SQL = "flips AS (SELECT m, ord, CASE WHEN lag(speaker) OVER w = lead(speaker) OVER w THEN lag(speaker) OVER w ELSE speaker END AS speaker FROM absorbed WINDOW w AS (PARTITION BY m ORDER BY ord))"


@query("w6_smoothed", f"WITH {ABSORBED_SQL}, {FLIPS_SQL} SELECT m, ord, speaker FROM flips")
def w6(spark, d):
    """Flips judged on the labels as they are after W7."""
    labels = w7(spark, d)
    return labels.select("m", "ord", sequence.single_flips(labels, ["m"], ["ord"], "speaker").alias("speaker"))


@query("w9_postprocessed", f"""WITH {ABSORBED_SQL}, {FLIPS_SQL}, t AS (SELECT f.m, f.ord, f.speaker, start, "end" FROM flips f JOIN seg s ON s.m = f.m AND s.ord = f.ord),
    l AS (SELECT *, lag(speaker) OVER w AS p, lag("end") OVER w AS q FROM t WINDOW w AS (PARTITION BY m ORDER BY start, ord)), i AS (SELECT *, {ISLAND.format('p IS NULL OR p <> speaker OR start - q > 0.5')} AS island FROM l)
    SELECT m, CAST(island - 1 AS BIGINT) AS ord, round(min(start), 6) AS start, round(arg_max("end", ord), 6) AS "end", speaker FROM i GROUP BY m, island, speaker""")  # fmt: skip
def w9(spark, d):
    return rounded(folds.fold(segments(spark, d).select("m", "ord", "start", "end", "speaker"), "m", ["start", "ord"], folds.postprocess, "m long, ord long, start double, end double, speaker string"))


@query("w12_snapped")
def w12(spark, d):
    def f(p: pd.DataFrame) -> pd.DataFrame:
        score = folds.break_scores(p["word"].tolist(), p["start"].to_numpy(), p["end"].to_numpy())
        return p[["ord"]].assign(speaker=folds.snapped(p["speaker"].tolist(), score))

    return folds.fold(words(spark, d), "m", ["ord"], f, "m long, ord long, speaker string")


@query("w13_polished_blocks")
def w13(spark, d):
    """W5, W12, W1 and W13 over labelled words."""
    return rounded(folds.fold(words(spark, d), "m", ["ord"], folds.labelled_to_blocks, "m long, " + folds.BLOCKS))


@query("j16_merged_transcript")
def j16(spark, d):
    """Words take the speaker at their middle (J5, J6), then W5, W12, W1 and W13."""
    w = words(spark, d).drop("speaker").withColumns({"pid": F.col("m") * 1_000_000 + F.col("ord"), "mid": (F.col("start") + F.col("end")) / 2})
    named = intervals.nearest_segment(w, turns(spark, d), KEY, "mid")
    return rounded(folds.fold(named.select("m", "ord", "word", "start", "end", "speaker"), "m", ["ord"], folds.labelled_to_blocks, "m long, " + folds.BLOCKS))


def voted_units(spark, d):
    u = sequence.units(words(spark, d), KEY, ["ord"], 0.25)
    spans = u.groupBy("m", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.withColumn("lid", F.col("m") * 1_000_000 + F.col("island"))
    return spans.join(intervals.weighted(spans, turns(spark, d), KEY), "lid").select("m", "island", "start", "end", "label", "share")


@query("w14_continuity", f"""WITH {TURN_SQL}, {WORDS_SQL}, l AS (SELECT *, lag("end") OVER (PARTITION BY m ORDER BY ord) AS p FROM words),
    n AS (SELECT *, sum(CASE WHEN p IS NULL OR start - p >= 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY ord ROWS UNBOUNDED PRECEDING) AS island FROM l),
    u AS (SELECT m, island, min(start) AS start, max("end") AS "end" FROM n GROUP BY 1, 2),
    v AS (SELECT u.m, island, t.label, round(sum(least(t."end", u."end") - greatest(t.start, u.start)), 9) AS s FROM u JOIN turns t ON t.m = u.m AND t.start < u."end" AND t."end" > u.start GROUP BY 1, 2, 3),
    b AS (SELECT m, island, arg_max(label, s * 1000 - label) AS label, max(s) / sum(s) AS share FROM v GROUP BY 1, 2),
    g AS (SELECT m, island, label, share, u.start - lag(u."end") OVER (PARTITION BY m ORDER BY island) AS gap FROM b JOIN u USING (m, island)),
    r AS (SELECT m, list({{'i': island, 'l': [label], 'keep': coalesce(gap < 0.25 AND share < 0.6, false)}} ORDER BY island) AS r FROM g GROUP BY 1),
    f AS (SELECT m, list_transform(r, lambda x: x.i) AS i, list_reduce(r, lambda a, x: {{'i': x.i, 'l': list_append(a.l, CASE WHEN x.keep THEN a.l[-1] ELSE x.l[1] END), 'keep': x.keep}}).l AS l FROM r)
    SELECT m, CAST(unnest(i) AS BIGINT) AS island, unnest(l) AS label FROM f""")  # fmt: skip
def w14(spark, d):
    def f(p: pd.DataFrame) -> pd.DataFrame:
        kept = folds.continued(p["label"].tolist(), p["share"].to_numpy(), p["start"].to_numpy(), p["end"].to_numpy())
        return p[["island"]].assign(label=kept)

    return folds.fold(voted_units(spark, d), "m", ["island"], f, "m long, island long, label int")


@query("w17_window_join")
def w17(spark, d):
    """Every window but the last of a conversation repeats its end at the next one's start; joining takes that out again."""
    t = text.words(F.col("text"))
    turns_ = table(spark, d, "conversations").select("conv_id", "turn", t.alias("w"))
    before = F.lag(F.slice("w", F.greatest(F.size("w") - 4, F.lit(1)), F.lit(5))).over(Window.partitionBy("conv_id").orderBy("turn"))
    shown = turns_.withColumn("x", F.when(before.isNotNull(), F.concat(before, F.col("w"))).otherwise(F.col("w")))
    packed = shown.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "x"))), lambda s: F.array_join(s.x, " ")).alias("windows"), F.sum(F.size("w")).alias("n_words"))
    return packed.select("conv_id", "n_words", F.size(text.words(text.merged(F.col("windows")))).alias("n_merged"))


@query("w19_split_regions", f"""WITH {WORDS_SQL}, l AS (SELECT m, arg_min(start, ord) AS first, arg_max("end", ord) AS last, list({{'at': arg_min_start, 'e': "end", 'cut': CAST([] AS STRUCT(s DOUBLE, e DOUBLE)[])}} ORDER BY ord) AS l FROM (SELECT *, first_value(start) OVER (PARTITION BY m ORDER BY ord) AS arg_min_start FROM words) GROUP BY 1),
    r AS (SELECT m, last, list_reduce(l, lambda a, x: CASE WHEN x.e - a.at >= 6.0 THEN {{'at': x.e, 'e': x.e, 'cut': list_append(a.cut, {{'s': a.at, 'e': x.e}})}} ELSE {{'at': a.at, 'e': x.e, 'cut': a.cut}} END, {{'at': first, 'e': first, 'cut': CAST([] AS STRUCT(s DOUBLE, e DOUBLE)[])}}) AS r FROM l),
    c AS (SELECT m, CASE WHEN last - r.at > 0.05 THEN list_append(r.cut, {{'s': r.at, 'e': last}}) ELSE r.cut END AS cut FROM r), u AS (SELECT m, unnest(cut) AS x, generate_subscripts(cut, 1) - 1 AS part FROM c)
    SELECT m, part, round(x.s, 6) AS start, round(x.e, 6) AS "end" FROM u""")  # fmt: skip
def w19(spark, d):
    def f(p: pd.DataFrame) -> pd.DataFrame:
        parts = folds.split_long(p["start"].to_numpy(), p["end"].to_numpy())
        return pd.DataFrame(parts, columns=["start", "end"]).assign(part=range(len(parts)))[["part", "start", "end"]]

    return rounded(folds.fold(words(spark, d), "m", ["ord"], f, "m long, part long, start double, end double"))


@query("w22_two_pass_attribution", f"""WITH {TURN_SQL}, {WORDS_SQL}, g AS (SELECT m, start, ord, label, (ord * 37 + m) % 100 < 18 AS low, lag(label) OVER o AS a, lead(label) OVER o AS b FROM turns WINDOW o AS (PARTITION BY m ORDER BY start, ord)),
    f AS (SELECT m, start, ord, CASE WHEN low OR coalesce(label <> a, false) OR coalesce(label <> b, false) OR avg(CAST(low AS INTEGER)) OVER (PARTITION BY m) > 0.06 THEN -1 ELSE label END AS sure FROM g),
    s AS (SELECT w.m, w.ord, arg_max(f.sure, (f.start, f.ord)) AS sure FROM words w JOIN f ON f.m = w.m AND f.start <= w.start GROUP BY 1, 2), z AS (SELECT m, arg_min(sure, (start, ord)) AS sure FROM f GROUP BY 1),
    n AS (SELECT w.m, w.ord, t.label, count(*) AS n FROM words w JOIN turns t ON t.m = w.m AND t.start < w."end" AND t."end" > w.start GROUP BY 1, 2, 3), v AS (SELECT m, ord, arg_max(label, n * 100 - label) AS own FROM n GROUP BY 1, 2),
    c AS (SELECT w.m, w.ord, coalesce(CASE WHEN coalesce(s.sure, z.sure) >= 0 THEN coalesce(s.sure, z.sure) END, v.own) AS got FROM words w LEFT JOIN s USING (m, ord) LEFT JOIN z USING (m) LEFT JOIN v USING (m, ord))
    SELECT m, ord, coalesce(got, last_value(got IGNORE NULLS) OVER (PARTITION BY m ORDER BY ord ROWS UNBOUNDED PRECEDING), 0) AS label FROM c""")  # fmt: skip
def w22(spark, d):
    """Words of certain windows take the window's label (J9); the others their own vote, else the last one's before them."""
    windows = turns(spark, d).withColumn("margin", (F.col("ord") * 37 + F.col("m")) % 100 / 100.0)
    flagged = sequence.uncertain(windows, KEY).withColumn("sure", F.when(~F.col("uncertain"), F.col("label")).otherwise(-1))
    w = words(spark, d).select("m", "ord", "start", "end")
    first = intervals.as_of(w, flagged, KEY, "start", "sure")
    spans = w.withColumn("lid", F.col("m") * 1_000_000 + F.col("ord"))
    own = intervals.majority(spans, turns(spark, d), KEY).withColumnRenamed("label", "own")
    j = first.withColumn("lid", F.col("m") * 1_000_000 + F.col("ord")).join(own, "lid", "left")
    got = F.coalesce(F.when(F.col("sure") >= 0, F.col("sure")), F.col("own"))
    back = Window.partitionBy("m").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn("label", F.coalesce(got, F.last(got, True).over(back), F.lit(0))).select("m", "ord", "label")


@query("w23_cascade", f"""WITH {TURN_SQL}, {WORDS_SQL}, w AS (SELECT *, (start + "end") / 2 AS mid FROM words),
    n AS (SELECT w.m, w.ord, t.label, count(*) AS n FROM w JOIN turns t ON t.m = w.m AND t.start < w."end" AND t."end" > w.start WHERE w.m % 2 = 0 GROUP BY 1, 2, 3),
    v AS (SELECT m, ord, ['assistant', 'system', 'user'][arg_max(label, n * 100 - label)] AS vote FROM n GROUP BY 1, 2),
    d AS (SELECT w.m, w.ord, t.speaker, t.ord AS o, CASE WHEN t.start <= mid AND mid <= t."end" THEN 0 ELSE 1 END AS miss, CASE WHEN t.start <= mid AND mid <= t."end" THEN 0 WHEN mid > t."end" THEN mid - t."end" ELSE t.start - mid END AS dist FROM w JOIN turns t USING (m)),
    near AS (SELECT m, ord, arg_min(speaker, (miss, dist, o)) AS near FROM d GROUP BY 1, 2)
    SELECT m, ord, coalesce(CASE WHEN ord % 5 = 0 THEN 'user' END, vote, near, 'SPEAKER_UNKNOWN') AS speaker FROM w LEFT JOIN v USING (m, ord) LEFT JOIN near USING (m, ord)""")  # fmt: skip
def w23(spark, d):
    """The precise label where there is one, else the window vote, else the nearest segment's."""
    w = words(spark, d).select("m", "ord", "start", "end", ((F.col("start") + F.col("end")) / 2).alias("mid"), (F.col("m") * 1_000_000 + F.col("ord")).alias("pid"))
    precise = w.where("ord % 5 = 0").select("pid", F.lit("user").alias("precise"))
    vote = intervals.majority(w.withColumnRenamed("pid", "lid"), turns(spark, d).where("m % 2 = 0"), KEY).select(F.col("lid").alias("pid"), F.element_at(F.array(F.lit("assistant"), F.lit("system"), F.lit("user")), F.col("label")).alias("vote"))
    near = intervals.nearest_segment(w, turns(spark, d), KEY, "mid").select("pid", "m", "ord", F.col("speaker").alias("near"))
    return near.join(precise, "pid", "left").join(vote, "pid", "left").select("m", "ord", F.coalesce("precise", "vote", "near").alias("speaker"))


def clustered(spark, d):
    from .vectors import meetings

    m = meetings(spark, d)
    labels = clusters.per_meeting(m, "auto", k=6)
    return m.select("meeting", "ord", "t0", "t1").join(labels, ["meeting", "ord"]).select(F.col("meeting").alias("m"), "ord", F.col("t0").alias("start"), F.col("t1").alias("end"), "label")


@query("w26_finalised")
def w26(spark, d):
    """At least three rows: clusters, grid vote, post-processing; else nothing."""
    enough = clustered(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("m"))).where("n >= 3")
    cells = sequence.grid_vote(enough, KEY).select("m", F.col("island").alias("ord"), "start", "end", F.format_string("SPEAKER_%02d", "label").alias("speaker"))
    return rounded(folds.fold(cells, "m", ["start", "ord"], folds.postprocess, "m long, ord long, start double, end double, speaker string"))


@query("w27_guided_timeline")
def w27(spark, d):
    """Clusters of guided regions, gaps filled to the meeting's length; nothing under three regions or 70 % coverage."""
    r = clustered(spark, d).withColumn("speaker", F.format_string("SPEAKER_%02d", "label"))
    w = Window.partitionBy("m")
    length = F.max("end").over(w)
    fit = r.withColumns({"n": F.count("*").over(w), "covered": F.sum(F.col("end") - F.col("start")).over(w) / length, "length": length}).where("n >= 3 and covered >= 0.7")
    return rounded(sequence.fill_gaps(fit, KEY, F.col("length")))


@query("w28_tiles", """WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 / 4096.0 AS t, value AS x FROM events), whole AS (SELECT user_id, sqrt(avg(x * x)) AS whole FROM e GROUP BY 1),
    g AS (SELECT user_id, start, sqrt(avg(x * x)) AS rms FROM (SELECT user_id, unnest([floor(t) - 1, floor(t)]) AS start, x FROM e) GROUP BY 1, 2) SELECT user_id, CAST(start AS BIGINT) AS start, round(rms, 6) AS rms FROM g JOIN whole USING (user_id) WHERE rms >= 0.5 * whole""")
def w28(spark, d):
    """Two-second tiles each second, kept where their level is half the whole's or more."""
    e = table(spark, d, "events").select("user_id", F.timestamp_seconds(F.unix_timestamp("ts") / 4096).alias("ts"), F.col("value").alias("x"))
    whole = e.groupBy("user_id").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("whole"))
    tiles = e.groupBy("user_id", F.window("ts", "2 seconds", "1 second").alias("t")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return tiles.join(whole, "user_id").where("rms >= 0.5 * whole").select("user_id", F.unix_timestamp("t.start").alias("start"), F.round("rms", 6).alias("rms"))


def levels(spark, d):
    e = table(spark, d, "events")
    frame = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return e.select(F.col("user_id").alias("m"), frame.alias("frame"), (F.col("value") % 7 / 70.0).alias("rms"))


#: Frames with the last quiet one so far; windows as a list and where the next one starts.
FRAMES_SQL = """fr AS (SELECT user_id AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value % 7 / 70.0::DOUBLE AS level FROM events),
    q AS (SELECT m, i, level, coalesce(max(CASE WHEN level < {0} THEN i END) OVER (PARTITION BY m ORDER BY i), -1) AS quiet FROM fr)"""
NO_WINDOWS = "CAST([] AS STRUCT(a BIGINT, b BIGINT)[])"

WINDOWS_SQL = f"""WITH {FRAMES_SQL.format(0.012)}, l AS (SELECT m, count(*) AS n, max(quiet) AS quiet, list({{'i': i, 'quiet': quiet}} ORDER BY i) AS l FROM q GROUP BY 1),
    s AS (SELECT m, n, quiet, list_reduce(l, lambda a, x: CASE WHEN x.i - a.at + 1 < a.want THEN a
        WHEN x.quiet > a.at + greatest(12, a.want - 8) THEN {{'at': greatest(a.at + 1, x.quiet), 'want': 25::BIGINT, 'w': list_append(a.w, {{'a': a.at, 'b': x.quiet + 1}})}}
        WHEN a.want >= 40 THEN {{'at': a.at + 40, 'want': 25::BIGINT, 'w': list_append(a.w, {{'a': a.at, 'b': a.at + 40}})}}
        ELSE {{'at': a.at, 'want': a.want + 10, 'w': a.w}} END, {{'at': 0::BIGINT, 'want': 25::BIGINT, 'w': {NO_WINDOWS}}}) AS s FROM l),
    e AS (SELECT m, n, s.at AS pos, s.w AS w, CASE WHEN n - s.at < 25 THEN NULL WHEN quiet > s.at + greatest(12, n - s.at - 8) THEN quiet + 1 WHEN n - s.at >= 40 THEN s.at + 40 END AS b, n - s.at >= 25 AND quiet > s.at + greatest(12, n - s.at - 8) AS again FROM s),
    f AS (SELECT m, n, CASE WHEN b IS NULL THEN pos WHEN again THEN greatest(pos + 1, b - 1) ELSE b END AS pos, CASE WHEN b IS NULL THEN w ELSE list_append(w, {{'a': pos, 'b': b}}) END AS w FROM e)
    SELECT m, x.a AS first, x.b AS last FROM (SELECT m, unnest(CASE WHEN pos < n THEN list_append(w, {{'a': pos, 'b': n}}) ELSE w END) AS x FROM f)"""  # fmt: skip

IMPORT_SQL = f"""WITH {FRAMES_SQL.format(0.012)}, l AS (SELECT m, count(*) AS n, list({{'i': i, 'quiet': quiet = i}} ORDER BY i) AS l FROM q GROUP BY 1),
    s AS (SELECT m, n, list_reduce(l, lambda a, x: CASE WHEN x.quiet AND x.i >= a.at + 25 OR x.i = a.at + 39 THEN {{'at': x.i + 1, 'w': list_append(a.w, {{'a': a.at, 'b': x.i + 1}})}} ELSE a END, {{'at': 0::BIGINT, 'w': {NO_WINDOWS}}}) AS s FROM l)
    SELECT m, x.a AS first, x.b AS last FROM (SELECT m, unnest(CASE WHEN s.at < n THEN list_append(s.w, {{'a': s.at, 'b': n}}) ELSE s.w END) AS x FROM s)"""  # fmt: skip

CUTS_SQL = f"""WITH {FRAMES_SQL.format(0.03)}, l AS (SELECT m, list({{'i': i, 'quiet': quiet = i}} ORDER BY i) AS l FROM q GROUP BY 1),
    s AS (SELECT m, list_reduce(l, lambda a, x: CASE WHEN x.i < a.want OR NOT x.quiet THEN {{'want': a.want, 'run': 0::BIGINT, 'c': a.c}} WHEN a.run = 1 THEN {{'want': x.i + 10, 'run': 0::BIGINT, 'c': list_append(a.c, x.i)}} ELSE {{'want': a.want, 'run': 1::BIGINT, 'c': a.c}} END, {{'want': 10::BIGINT, 'run': 0::BIGINT, 'c': CAST([] AS BIGINT[])}}).c AS c FROM l)
    SELECT m, unnest(c) AS cut FROM s"""  # fmt: skip


def cut(spark, d, f, schema: str):
    return folds.fold(levels(spark, d), "m", ["frame"], lambda p: f(p["rms"].to_numpy()), "m long, " + schema)


@query("x1_live_windows", WINDOWS_SQL)
def x1(spark, d):
    def f(level: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(folds.window_cuts(level, step=1.0), columns=["first", "last"])

    return cut(spark, d, f, "first long, last long")


@query("x2_import_windows", IMPORT_SQL)
def x2(spark, d):
    def f(level: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(folds.window_cuts(level, step=1.0, backwards=False, overlap=0.0), columns=["first", "last"])

    return cut(spark, d, f, "first long, last long")


@query("x3_dictation_cuts", CUTS_SQL)
def x3(spark, d):
    def f(level: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"cut": folds.tail_cuts(level, step=1.0, target=10.0, run=2, quiet=0.03)}, dtype="int64")

    return cut(spark, d, f, "cut long")


PHRASES = (
    "rappelle-moi d'appeler Marie demain à 10h", "n'oublie pas le dossier vendredi avant midi", "dans 20 minutes sortir le plat", "fais-moi un rappel pour le 15 juin", "on se voit ce soir à 8 heures et demie",
    "mets un rappel ce week-end", "rappel de payer le loyer le 3", "une phrase sans date", "pense à prendre le pain cet après-midi", "dans une demi-heure",
)


def phrases(spark, d):
    """Every turn as it was said, each at a clock of its own; even turns begin with a reminder."""
    k = F.col("conv_id") + F.col("turn")
    pick = F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod(F.col("conv_id"), F.lit(len(PHRASES))) + 1).cast("int"))
    said = F.when(F.col("turn") % 2 == 0, F.concat(pick, F.lit(". "), "text")).otherwise(F.col("text"))
    c = table(spark, d, "conversations").repartition(spark.sparkContext.defaultParallelism, "conv_id", "turn")  # reading is long work on little data
    return c.select("conv_id", "turn", said.alias("text"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), k)).alias("now"))


@query("f5_f8_reminders")
def f8(spark, d):
    """Times and titles of whole turns at a given clock."""
    return phrases(spark, d).withColumn("r", reminders.reminder("text", "now")).select("conv_id", "turn", "r.title", "r.due", "r.wording", "r.confidence", "r.lead_minutes")


@query("p17_p18_detected")
def p17(spark, d):
    return phrases(spark, d).withColumn("r", reminders.reminder("text", "now")).select("conv_id", "turn", "r.reminder", "r.timed")


@query("f28_transcript_source", f"""WITH t AS (SELECT conv_id, turn, text, conv_id * 1000 + turn AS doc_id FROM conversations), b AS (SELECT doc_id, {replaced_sql('text', BOILERPLATE_SQL)} AS text FROM t), {without_repeats_sql('b')},
    j AS (SELECT *, array_to_string(list_filter([regexp_replace(left(text, 40), '^\\s+|\\s+$', '', 'g'), regexp_replace(substr(text, 41), '^\\s+|\\s+$', '', 'g')], lambda x: x <> ''), ' ') AS w FROM t),
    a AS (SELECT j.*, r.text AS clean, CASE WHEN conv_id % 7 = 0 THEN 'none' WHEN turn > 2 THEN 'tail' WHEN turn % 2 = 0 THEN 'small' ELSE 'large' END AS source FROM j LEFT JOIN r USING (doc_id))
    SELECT conv_id, turn, source, sha256(CASE source WHEN 'none' THEN '' WHEN 'tail' THEN trim(regexp_replace(regexp_replace(regexp_replace(w, '\\s+', ' ', 'g'), ' ([,.;:!?…)\\]»%])', '\\1', 'g'), '([(\\[«]) ', '\\1', 'g')) WHEN 'small' THEN {TIDY_SQL.format('clean')} ELSE text END) AS sha FROM a""")  # fmt: skip
def f28(spark, d):
    """Silence gives nothing; windows of the tail are assembled where there are any; else the sure small model's text, else the large one's."""
    c = table(spark, d, "conversations")
    silent, tail, sure = F.col("conv_id") % 7 == 0, F.col("turn") > 2, F.col("turn") % 2 == 0
    made = F.when(silent, "").when(tail, text.assembled(F.array(F.left("text", F.lit(40)), F.substring("text", 41, 1 << 20)))).when(sure, text.without_hallucinations(F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.when(silent, "none").when(tail, "tail").when(sure, "small").otherwise("large").alias("source"), F.sha2(made, 256).alias("sha"))


@query("f17_client_id")
def f17(spark, d):
    """The settings' id, else the backup's, else a new one; whether it is new."""
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise("").alias("a"), F.when(F.col("s_suppkey") % 3 == 1, F.col("s_name")).alias("b"))
    have = F.coalesce(F.nullif("a", F.lit("")), F.nullif("b", F.lit("")))
    return s.select("s_suppkey", F.coalesce(have, F.uuid()).alias("id"), have.isNull().alias("fresh"))


TITLE_SQL = "coalesce(nullif(rtrim(left(trim(regexp_replace(regexp_replace({0}, '[\\\\/:*?\"<>|\\n\\r\\t]+', ' ', 'g'), '\\s+', ' ', 'g')), 60)), ''), 'Réunion')"


@query("k12_meeting_notes", f"""WITH f AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS n FROM conversations GROUP BY 1, 2),
    b AS (SELECT conv_id, string_agg('**Voix ' || n || '**: ' || text, chr(10) || chr(10) ORDER BY turn) AS body, {TITLE_SQL.format('arg_min(text, turn)')} AS title FROM conversations JOIN f USING (conv_id, role) GROUP BY 1)
    SELECT conv_id, title || '-' || conv_id || '.md' AS file, sha256('---' || chr(10) || 'id: ' || conv_id || chr(10) || '---' || chr(10) || '# ' || title || chr(10) || chr(10) || body) AS sha FROM b""")  # fmt: skip
def k12(spark, d):
    """One note a meeting, found again by the id it carries; speakers numbered by first appearance."""
    c = table(spark, d, "conversations")
    first = c.groupBy("conv_id", "role").agg(F.min("turn").alias("f"))
    number = first.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("f")))
    line = F.concat(F.lit("**Voix "), F.col("n").cast("string"), F.lit("**: "), F.col("text"))
    body = c.join(number.drop("f"), ["conv_id", "role"]).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x.l), "\n\n").alias("body"), F.min_by("text", "turn").alias("opening"))
    note = F.concat(F.lit("---\nid: "), F.col("conv_id").cast("string"), F.lit("\n---\n# "), text.safe_title(F.col("opening")), F.lit("\n\n"), F.col("body"))
    return body.select("conv_id", F.concat(text.safe_title(F.col("opening")), F.lit("-"), F.col("conv_id").cast("string"), F.lit(".md")).alias("file"), F.sha2(note, 256).alias("sha"))


@query("x17_isolated_batches", """WITH b AS (SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 8 AS batch FROM embeddings), f AS (SELECT *, max(CAST(vec_id % 29 = 3 AS INTEGER)) OVER (PARTITION BY label, batch) AS bad FROM b)
    SELECT label, vec_id, CASE WHEN bad = 1 OR max(CASE WHEN batch = 0 THEN bad END) OVER (PARTITION BY label) = 1 THEN NULL ELSE vec_id / 2.0::DOUBLE END AS result FROM f""")  # fmt: skip
def x17(spark, d):
    """Eight vectors of a label are a batch; one with a vector that can't be taken fails."""

    def half(b: pd.DataFrame) -> pd.DataFrame:
        if (b["vec_id"] % 29 == 3).any():
            raise clusters.BatchFailed("a vector that can't be taken")
        return b.assign(result=b["vec_id"] / 2)

    e = table(spark, d, "embeddings").select("label", "vec_id")
    return clusters.isolated(e, "label", "vec_id", 8, half, "result double")
