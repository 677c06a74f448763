"""Voices: cosine, centroids, matching, neighbours, clustering; and signal features (V, L8-L10, J10, J11, F18-F24)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import clusters, vectors
from ..registry import query
from ..session import table

E_SQL = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL)"
CENT_SQL = """p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY 1, 2),
    c0 AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1), cent AS (SELECT label, list_transform(c, lambda x: x / (sqrt(list_inner_product(c, c)) + 1e-9)) AS c FROM c0)"""


def voices(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "label", vectors.doubles("embedding").alias("v"))


def bank(spark, d):
    """Enrolled: the centroids of all vectors."""
    return vectors.centroids(voices(spark, d), "label", "v")


@query("v1_cosine", f"WITH {E_SQL} SELECT a.vec_id, round(list_inner_product(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def v1(spark, d):
    e = voices(spark, d)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(b, "vec_id").select("vec_id", F.round(vectors.dot("v", "w"), 6).alias("cosine"))


@query("v2_unit", f"WITH {E_SQL} SELECT vec_id, round(sqrt(list_inner_product(u, u)), 6) AS length, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(list_transform(v, lambda x: x * 3), lambda x: x / (3 * sqrt(list_inner_product(v, v)) + 1e-9)) AS u FROM e)")
def v2(spark, d):
    u = voices(spark, d).select("vec_id", vectors.unit(F.transform("v", lambda x: x * 3)).alias("u"))
    return u.select("vec_id", F.round(F.sqrt(vectors.dot("u", "u")), 6).alias("length"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query("v3_centroids", f"WITH {E_SQL}, {CENT_SQL} SELECT label, round(c[1], 6) AS first, round(c[64], 6) AS last, (SELECT count(*) FROM e WHERE e.label = cent.label) AS n FROM cent")
def v3(spark, d):
    return bank(spark, d).select("label", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.element_at("centroid", -1), 6).alias("last"), "n")


@query("v4_medoids", f"""WITH {E_SQL}, k AS (SELECT *, vec_id // 40 AS meeting FROM e), s AS (SELECT a.meeting, a.label, a.vec_id, round(median(list_inner_product(a.v, b.v)), 9) AS m FROM k a JOIN k b USING (meeting, label) GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY meeting, label ORDER BY m DESC, vec_id) AS r, count(*) OVER (PARTITION BY meeting, label) AS n FROM s) SELECT meeting, label, n, CASE WHEN n > 2 THEN vec_id END AS id FROM r WHERE r = 1""")  # fmt: skip
def v4(spark, d):
    """Per voice of a meeting of forty vectors."""
    e = voices(spark, d).withColumn("meeting", F.floor(F.col("vec_id") / 40).cast("long"))
    return vectors.medoids(e, ["meeting", "label"], "v", "vec_id")


@query("v6_silhouette", f"""WITH {E_SQL}, s AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg(1 - list_inner_product(a.v, b.v)) FILTER (WHERE a.vec_id <> b.vec_id) AS d FROM e a, e b GROUP BY 1, 2, 3),
    x AS (SELECT vec_id, max(d) FILTER (WHERE la = lb) AS a, min(d) FILTER (WHERE la <> lb) AS b FROM s GROUP BY 1) SELECT round(avg((b - a) / (greatest(a, b) + 1e-9)), 5) AS silhouette FROM x""")  # fmt: skip
def v6(spark, d):
    """The exact value: mean cosine distances to a label follow from the label's sum vector, so no pair of rows is formed."""
    return clusters.silhouette(voices(spark, d), "label", "v", "vec_id").select(F.round("silhouette", 5).alias("silhouette"))


@query("v8_nearest_centroid", f"WITH {E_SQL}, {CENT_SQL}, s AS (SELECT vec_id, cent.label, round(list_inner_product(v, c), 9) AS s FROM e, cent) SELECT vec_id, label AS nearest, round(s, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS r FROM s) WHERE r = 1")
def v8(spark, d):
    p = vectors.nearest(voices(spark, d), bank(spark, d), "vec_id", "v", "label")
    return p.select("vec_id", "nearest", F.round("cosine", 6).alias("cosine"))


@query("v9_known_voices", f"""WITH {E_SQL}, {CENT_SQL}, s AS (SELECT vec_id, cent.label AS id, round(list_inner_product(v, c), 9) AS s FROM e, cent),
    r AS (SELECT vec_id, id, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, id) AS r, lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC, id) AS second FROM s)
    SELECT vec_id, CASE WHEN s >= 0.3 AND s - coalesce(second, -1) >= 0.02 THEN id END AS id, round(s, 6) AS score FROM r WHERE r = 1""")  # fmt: skip
def v9(spark, d):
    """V9, J10 and L8, with thresholds that these labels can reach."""
    known = bank(spark, d).select(F.col("label").alias("id"), F.concat(F.lit("n"), "label").alias("name"), "centroid")
    probes = voices(spark, d).select("vec_id", F.col("v").alias("centroid"))
    return vectors.match_known(probes, known, "vec_id", 0.3, 0.02).select("vec_id", "id", F.round("score", 6).alias("score"))


@query("v11_next_id", "SELECT 'voice_' || lpad(CAST(max(label) + 1 AS VARCHAR), 3, '0') AS id FROM embeddings")
def v11(spark, d):
    ids = table(spark, d, "embeddings").select(F.concat(F.lit("voice_"), F.lpad(F.col("label").cast("string"), 3, "0")).alias("id"))
    return ids.agg(F.concat(F.lit("voice_"), F.lpad((F.coalesce(F.max(F.substring_index("id", "_", -1).try_cast("int")), F.lit(0)) + 1).cast("string"), 3, "0")).alias("id"))


@query("v14_dissolved", """WITH s AS (SELECT user_id AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_id, floor(epoch(ts) - 1704067200) / 4096 AS start, floor(epoch(ts) - 1704067200) / 4096 + (1 + event_id % 9) / 4.0 AS "end",
        CASE WHEN event_id % 23 = 0 THEN 7 WHEN event_id % 29 = 0 THEN 8 ELSE event_id % 3 END AS label FROM events),
    p AS (SELECT m, label, round(sum("end" - start), 9) AS s FROM s GROUP BY 1, 2), t AS (SELECT *, sum(s) OVER (PARTITION BY m) AS t FROM p), mj AS (SELECT m, label FROM t WHERE s >= 8.0 OR s / t >= 0.10),
    c AS (SELECT s.*, (start + "end") / 2 AS c, (m, label) IN (SELECT (m, label) FROM mj) AS major FROM s),
    x AS (SELECT a.m, a.event_id, CASE WHEN a.major THEN a.label ELSE (SELECT arg_min(b.label, round(abs(b.c - a.c), 9) * 1000000 + b.ord) FROM c b WHERE b.m = a.m AND b.major) END AS label FROM c a)
    SELECT event_id, CAST(dense_rank() OVER (PARTITION BY m ORDER BY label) - 1 AS INTEGER) AS label FROM x""")  # fmt: skip
def v14(spark, d):
    e = table(spark, d, "events")
    start = F.floor(F.unix_micros("ts") / 1_000_000 - 1704067200).cast("double") / 4096
    k = F.col("event_id")
    s = e.select(F.col("user_id").alias("m"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"), "event_id", start.alias("start"), (start + (1 + k % 9) / 4.0).alias("end"), F.when(k % 23 == 0, 7).when(k % 29 == 0, 8).otherwise(k % 3).alias("label"))
    return vectors.dissolve_minor(s, ["m"], least_s=8.0, least_share=0.10).select("event_id", "label")


@query("l9_neighbours", f"WITH {E_SQL}, s AS (SELECT a.vec_id AS x, b.vec_id AS y, round(list_inner_product(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id) SELECT x, y, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS rank FROM s) WHERE rank <= 5")
def l9(spark, d):
    return vectors.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 5).select("x", "y", "rank")


@query("l10_subsample", "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) SELECT vec_id FROM r WHERE i IN (SELECT CAST(floor(k * (n - 1) / 99.0) AS BIGINT) FROM range(0, 100) t(k), (SELECT count(*) AS n FROM embeddings))")
def l10(spark, d):
    return clusters.even_subsample(table(spark, d, "embeddings").select("vec_id"), "vec_id", 100)


CLUSTER_IN = "meeting long, ord long, t0 double, t1 double, seg_id long, v array<double>"


def meetings(spark, d):
    """Forty vectors a meeting, two seconds each."""
    i = F.col("vec_id")
    return voices(spark, d).select(F.floor(i / 40).cast("long").alias("meeting"), (i % 40).cast("long").alias("ord"), (i % 40 * 2.0).alias("t0"), (i % 40 * 2.0 + 2).alias("t1"), F.floor(i % 40 / 3).cast("long").alias("seg_id"), "v")


@query("v5_kmeans")
def v5(spark, d):
    return clusters.per_meeting(meetings(spark, d), "kmeans", k=3)


@query("v7_merged_clusters")
def v7(spark, d):
    return clusters.per_meeting(meetings(spark, d), "merged", k=6)


@query("v12_v13_speaker_count")
def v12(spark, d):
    return clusters.per_meeting(meetings(spark, d), "count", k=6)


@query("v15_viterbi")
def v15(spark, d):
    return clusters.per_meeting(meetings(spark, d), "viterbi", k=3)


@query("v16_clustered")
def v16(spark, d):
    return clusters.per_meeting(meetings(spark, d), "auto", k=6)


@query("v10_enrolled")
def v10(spark, d):
    """Forty banks; evidence comes with an id, with a name in another case, or with a name that no bank knows."""
    v, k = voices(spark, d), F.col("vec_id")
    bank_of, name = (k % 40).alias("bank"), F.concat(F.lit("Name "), F.col("label") % 5)
    new = v.where("vec_id >= 40").select(bank_of, k.alias("ord"), F.when(k % 3 == 0, F.lit(1)).alias("id"), F.when(k % 3 == 1, F.upper(name)).otherwise(name).alias("name"), F.col("v").alias("centroid"), (10.0 + k % 7).alias("seconds"))
    known = v.where("vec_id < 40").select(bank_of, F.lit(1).alias("id"), name.alias("name"), F.col("v").alias("centroid"), F.lit(60.0).alias("seconds"), F.lit(1).alias("meetings"))
    return clusters.enrolled(known, new).select("bank", "id", "name", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round("seconds", 3).alias("seconds"), "meetings")


@query("j11_v17_assignment")
def j11(spark, d):
    """Greedy one to one, the highest score first."""
    e = voices(spark, d)
    known = vectors.centroids(e, "label", "v").select(F.col("label").alias("id"), F.concat(F.lit("n"), "label").alias("name"), "centroid")
    m = vectors.match_known(e.select("vec_id", F.col("v").alias("centroid")), known, "vec_id", -1.0, 0.0)
    return clusters.one_to_one(m.withColumn("meeting", F.floor(F.col("vec_id") / 20).cast("long")), "meeting", "vec_id", "id", "score")


SIG_SQL = "g AS (SELECT user_id, list(value / 500 - 0.3 ORDER BY ts, event_id) AS x FROM events GROUP BY 1)"


def signals(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.col("value") / 500 - 0.3).alias("x")))).alias("s"))
    return e.select("user_id", F.transform("s", lambda s: s.x).alias("x"))


@query("f18_levels", f"WITH {SIG_SQL} SELECT user_id, round(sqrt(list_inner_product(x, x) / len(x)), 6) AS rms, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS peak FROM g")
def f18(spark, d):
    return signals(spark, d).select("user_id", F.round(signal.rms(F.col("x")), 6).alias("rms"), F.round(signal.peak(F.col("x")), 6).alias("peak"))


@query("f19_gain", f"WITH {SIG_SQL} SELECT user_id, round(list_sum(list_transform(x, lambda v: least(1, greatest(-1, v * 0.1 / sqrt(list_inner_product(x, x) / len(x)))))), 5) AS total FROM g")
def f19(spark, d):
    return signals(spark, d).select("user_id", F.round(F.aggregate(signal.gained(F.col("x")), F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("f20_downmix", f"WITH {SIG_SQL} SELECT user_id, CAST(len(list_filter(range(len(x)), lambda i: i % 2 = 0)) AS INTEGER) AS n, round(list_sum(list_transform(range(len(x) // 2), lambda i: (x[i * 2 + 1] + x[i * 2 + 2]) / 2)), 5) AS total FROM g")
def f20(spark, d):
    return signals(spark, d).select("user_id", F.size(signal.first_channel(F.col("x"), 2)).alias("n"), F.round(F.aggregate(signal.mean_channels(F.col("x"), 2), F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("f21_resampled")
def f21(spark, d):
    return signals(spark, d).select("user_id", F.transform(signal.resampled("x", F.lit(48), F.lit(16)), lambda v: F.round(v, 6)).alias("x"))


@query("f22_mixed", f"WITH {SIG_SQL}, s AS (SELECT user_id, list_transform(range(len(x)), lambda i: (x[i + 1] + coalesce(x[i + 4], 0)) * 0.71) AS s FROM g), t AS (SELECT user_id, s, list_max(list_transform(s, lambda v: abs(v))) AS top FROM s) SELECT user_id, CAST(list_sum(list_transform(s, lambda v: floor((CASE WHEN top > 0.99 THEN v * (0.99 / top) ELSE v END) * 32767))) AS BIGINT) AS total FROM t")
def f22(spark, d):
    m = signal.mixed(F.col("x"), F.slice("x", F.lit(4), F.size("x")))
    return signals(spark, d).select("user_id", F.aggregate(m, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("f23_fitted", f"WITH {SIG_SQL} SELECT user_id, 50 AS n, round(CASE WHEN len(x) >= 50 THEN x[(len(x) - 50) // 2 + 1] ELSE x[1] END, 6) AS first, round(CASE WHEN len(x) >= 50 THEN x[(len(x) - 50) // 2 + 50] ELSE x[(49 % len(x)) + 1] END, 6) AS last FROM g")
def f23(spark, d):
    f = signals(spark, d).select("user_id", signal.fitted(F.col("x"), 50).alias("f"))
    return f.select("user_id", F.size("f").alias("n"), F.round(F.get("f", F.lit(0)), 6).alias("first"), F.round(F.element_at("f", -1), 6).alias("last"))


@query("f24_quiet_cut", f"WITH {SIG_SQL}, m AS (SELECT user_id, list_transform(range(len(x) - 4), lambda i: round((x[i + 1] + x[i + 2] + x[i + 3] + x[i + 4] + x[i + 5]) / 5, 9)) AS m FROM g WHERE len(x) >= 5) SELECT user_id, CAST(list_position(m, list_min(m)) - 1 AS INTEGER) AS at FROM m")
def f24(spark, d):
    return signals(spark, d).where("size(x) >= 5").select("user_id", signal.quiet_cut(F.col("x"), 5).alias("at"))
