"""Merges, folds, timelines, clusters, sources and streams on small inputs."""

import json
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from speechframe.functions import checks, signal
from speechframe.operators import clusters, export, folds, intervals, sequence, upsert, vectors
from speechframe.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_backfill_twice_is_once(spark):
    day = lambda n: date(2024, 1, n)
    counted = spark.createDataFrame([(day(5), 300)], "day date, words long")
    history = spark.createDataFrame([(day(3), 100), (day(3), 50), (day(5), 999), (day(7), 1)], "day date, words long")
    once = upsert.backfill(counted, history, "day", ["words"])
    assert rows(once) == [(day(3), 150), (day(5), 300)]
    assert rows(upsert.backfill(once, history, "day", ["words"])) == rows(once)
    assert upsert.backfill(counted.limit(0), history, "day", ["words"]).count() == 3


def test_merge_rules(spark):
    old = spark.createDataFrame([(1, "a", "x", 5.0), (2, "b", "y", 1.0)], "k int, name string, mail string, s double")
    new = spark.createDataFrame([(2, "", " ", 0.5), (3, "c", "z", 2.0)], "k int, name string, mail string, s double")
    rules = {"name": "replace", "mail": "sticky", "s": "greatest"}
    got = upsert.merge(old, new, ["k"], rules)
    assert rows(got) == [(1, "a", "x", 5.0), (2, "", "y", 1.0), (3, "c", "z", 2.0)]
    assert rows(upsert.merge(got, new, ["k"], rules)) == rows(got)


def test_folding_is_ascii_only(spark):
    e = spark.createDataFrame([("Été", 1), ("été", 2), ("ABC", 3), ("abc", 4), ("  ", 5)], "w string, n int")
    assert rows(upsert.upsert_folded(e, "w", "n", ["w"], ["n"]).select("w", "n")) == [("ABC", 4), ("Été", 1), ("été", 2)]


def test_update_refuses_unknown_columns(spark):
    with pytest.raises(ValueError):
        upsert.update(spark.range(1), {"a"}, F.lit(True), b=F.lit(1))


def test_short_segments_see_earlier_changes():
    start, end = np.array([0, 3, 3.5, 4.0]), np.array([3, 3.5, 4.0, 4.2])
    assert folds.absorb_short(start, end, ["a", "b", "c", "d"]) == ["a", "a", "a", "a"]


def test_duration_of_exactly_one_second_stays():
    assert folds.absorb_short(np.array([0.0, 5.0, 6.0]), np.array([5.0, 6.0, 9.0]), ["a", "b", "a"]) == ["a", "b", "a"]


def test_postprocess_joins():
    p = pd.DataFrame({"start": [0.0, 2.0, 2.3, 8.0], "end": [2.0, 2.3, 5.0, 9.5], "speaker": ["a", "b", "a", "a"]})
    assert folds.postprocess(p)[["start", "end", "speaker"]].values.tolist() == [[0.0, 5.0, "a"], [8.0, 9.5, "a"]]


def test_snapping_moves_to_the_sentence_end():
    words = ["Oui", "bien", "sûr.", "Et", "toi"]
    t = np.arange(5) * 0.3
    score = folds.break_scores(words, t, t + 0.3)
    assert folds.snapped(["a", "a", "b", "b", "b"], score) == ["a", "a", "a", "b", "b"]
    assert folds.snapped(["a", "b", "b", "b", "b"], score) == ["a", "a", "a", "b", "b"]


def test_polish():
    assert folds.polished(["Ça va", "? Oui", "fini. C", "'est bien"]) == ["Ça va?", "Oui", "fini.", "C'est bien"]


def test_continuity():
    assert folds.continued([0, 1, 1], [0.9, 0.5, 0.5], [0, 1.1, 3], [1, 2, 4]) == [0, 0, 1]


def test_tail_cuts():
    level = np.full(600, 0.1)
    level[500:510] = 0.0
    assert folds.tail_cuts(level) == [502]
    assert folds.tail_cuts(np.full(900, 0.1)) == []


def test_windows_cover_and_overlap():
    level = np.full(700, 0.1)
    level[240] = 0.0
    cuts = folds.window_cuts(level)
    assert cuts[0] == (0, 241) and cuts[1][0] == 231 and cuts[-1][1] == 700


def test_nearest_segment(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 5.0, "A"), (1, 1, 5.0, 9.0, "B"), (1, 2, 20.0, 25.0, "C")], "m int, ord int, start double, end double, speaker string")
    p = spark.createDataFrame([(1, 1, 5.0), (2, 1, 10.0), (3, 1, 14.5), (4, 1, 30.0), (5, 2, 1.0)], "pid long, m int, t double")
    got = dict(intervals.nearest_segment(p, s, ["m"], "t").select("pid", "speaker").collect())
    assert got == {1: "A", 2: "B", 3: "B", 4: "C", 5: "SPEAKER_UNKNOWN"}


def test_reassign_keeps_the_duration(spark):
    b = spark.createDataFrame([(1, 0, "A", 0.0, 10.0, "a b c d e"), (1, 1, "B", 10.0, 12.0, "f")], "m int, ord int, speaker string, start double, end double, text string")
    e = spark.createDataFrame([(1, 0, 3, 99, "B")], "m int, ord int, first int, last int, speaker string")
    got = sequence.reassign(b, ["m"], e).orderBy("island").select("speaker", "start", "end", "text").collect()
    assert [tuple(r) for r in got] == [("A", 0.0, 6.0, "a b c"), ("B", 6.0, 12.0, "d e f")]


def voices(k, n, noise=0.045, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(k, 192))
    x = np.concatenate([a / np.linalg.norm(a) + noise * rng.normal(size=(m, 192)) for a, m in zip(c, n)])
    return x / np.linalg.norm(x, axis=1, keepdims=True), np.repeat(range(k), n)


@pytest.mark.parametrize("sizes", [(60, 100), (60, 100, 140), (60, 100, 140, 180)])
def test_speaker_count(sizes):
    x, truth = voices(len(sizes), sizes)
    k, labels, _ = clusters.count_voices(x)
    assert k == len(sizes) and all(len(set(labels[truth == t])) == 1 for t in range(k))


def test_one_voice_and_too_few():
    assert clusters.count_voices(voices(1, (80,))[0])[0] == 1
    assert clusters.spectral_count(voices(2, (3, 3))[0], 4) is None


def test_split_voice_is_merged():
    x, truth = voices(2, (60, 60))
    split = truth.copy()
    split[:30] = 2
    assert clusters.merge_alike(x, split).max() == 1


def test_viterbi_keeps_the_turn():
    c = np.eye(2)
    x = np.array([[1, 0], [1, 0], [0.6, 0.8], [1, 0]], float)
    assert clusters.viterbi(x, c).tolist() == [0, 0, 0, 0] and clusters.viterbi(x, c, 0.0).tolist() == [0, 0, 1, 0]


def test_known_voice_needs_a_margin(spark):
    known = spark.createDataFrame([(1, "Ann", [1.0, 0.0]), (2, "Bo", [0.9, 0.43589])], "id int, name string, centroid array<double>")
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "p int, centroid array<double>")
    assert rows(vectors.match_known(p, known, "p").select("p", "id")) == [(1, None), (2, None)]
    assert rows(vectors.match_known(p, known.where("id = 1"), "p").select("p", "id")) == [(1, 1), (2, None)]


def test_large_banks_meet_the_probes_in_blocks(spark):
    r = np.random.default_rng(3)
    unit = lambda n: [(v / np.linalg.norm(v)).tolist() for v in r.normal(size=(n, 8))]
    bank = [*enumerate(unit(23), 1), (24, [1.0, 0.0]), (25, None)]
    known = spark.createDataFrame([(i, f"n{i}", v) for i, v in [*bank, (30, bank[4][1])]], "id long, name string, centroid array<double>")
    p = spark.createDataFrame([*enumerate(unit(40)), (90, bank[4][1]), (91, [0.0] * 3), (92, None)], "p long, centroid array<double>")
    for least, margin in ((0.75, 0.12), (0.3, 0.02), (0.99, 0.0)):
        few, many = (rows(vectors.match_known(p, known, "p", least, margin, most, 7)) for most in (100, 3))
        assert few == many and len(few) == 43
    few, many = (rows(vectors.nearest(p, known.drop("name"), "p", "centroid", "id", most, 7).select("p", "nearest", "cosine")) for most in (100, 3))
    assert few == many
    assert [x[1:] for x in few if x[0] == 90] == [(5, 1.0)] and [x[1:] for x in few if x[0] == 91] == [(1, -1.0)]
    e = spark.createDataFrame([(i, i * 7 % 12, v) for i, v in enumerate(unit(60))], "i long, l int, v array<double>")
    few, many = (clusters.silhouette(e, "l", "v", "i", most, 7).first()[0] for most in (100, 3))
    assert few == pytest.approx(many, abs=1e-8)


def test_medoid_of_a_voice(spark):
    e = spark.createDataFrame([(0, 0, 3, [1.0, 0.0]), (0, 0, 2, [1.0, 0.0]), (0, 0, 1, [0.0, 1.0]), (0, 1, 4, [1.0, 0.0]), (0, 1, 5, [0.0, 1.0]), (1, 0, 6, None)], "m long, l int, i long, v array<double>")
    assert rows(vectors.medoids(e, ["m", "l"], "v", "i", 2)) == [(0, 0, 3, 2), (0, 1, 2, None)]


def test_smoothing_follows_absorption(spark):
    from compare import SF
    from speechframe.queries import QUERIES

    def labels(name):
        out = {}
        for r in QUERIES[name](spark, SF).orderBy("m", "ord").collect():
            out.setdefault(r.m, []).append(r.speaker)
        return out

    assert labels("w6_smoothed") == {m: folds.median3(x) for m, x in labels("w7_absorbed").items()}


KNOWN, NEW = "bank long, id long, name string, centroid array<double>, seconds double, meetings int", "bank long, ord long, id long, name string, centroid array<double>, seconds double"


def test_enrolment(spark):
    known = spark.createDataFrame([(1, 1, "Ann", [1.0, 0.0], 30.0, 2)], KNOWN)
    new = spark.createDataFrame([(1, 0, 1, "Ann", [0.0, 1.0], 30.0), (1, 1, 1, "Ann", [0.0, 1.0], 5.0), (1, 2, 2, "Voix 3", [0.0, 1.0], 60.0), (1, 3, None, " ", [0.0, 1.0], 60.0), (1, 4, None, "Bob", [0.0, 0.0], 60.0)], NEW)
    r = clusters.enrolled(known, new).collect()
    assert len(r) == 1 and r[0].meetings == 3 and r[0].seconds == 60.0 and r[0].centroid == pytest.approx([2**-0.5, 2**-0.5])


def test_a_voice_is_found_by_name_after_its_id(spark):
    known = spark.createDataFrame([(1, 1, "Marie", [1.0, 0.0], 30.0, 1), (1, 4, "Paul", [0.0, 1.0], 30.0, 1), (2, 1, "Eva", [0.0, 1.0], 30.0, 1)], KNOWN)
    new = spark.createDataFrame([
        (1, 0, 9, "marie", [1.0, 0.0], 20.0),  # an id no one has, a name in another case
        (1, 1, 4, "Marie", [0.0, 1.0], 20.0),  # the id goes before the name, and renames
        (1, 2, None, "PAUL", [1.0, 1.0], 20.0),  # no one has this name any more
        (1, 3, None, "paul", [1.0, 1.0, 1.0], 20.0),  # found as named a moment ago; another dimension replaces
        (2, 0, None, "Marie", [1.0, 0.0], 20.0),
    ], NEW)
    got = {(r.bank, r.id): (r.name, r.seconds, r.meetings, len(r.centroid)) for r in clusters.enrolled(known, new).collect()}
    assert got == {(1, 1): ("marie", 50.0, 2, 2), (1, 4): ("Marie", 50.0, 2, 2), (1, 5): ("paul", 20.0, 2, 3), (2, 1): ("Eva", 30.0, 1, 2), (2, 2): ("Marie", 20.0, 1, 2)}


def test_isolated_batches(spark):
    def f(b):
        if (b["x"] == 0).any():
            raise clusters.BatchFailed("zero")
        return b.assign(y=1.0 / b["x"])

    df = spark.createDataFrame([(1, k, k + 1) for k in range(6)] + [(2, k, k) for k in range(6)] + [(3, k, int(k != 2)) for k in range(6)], "k long, ord long, x long")
    got = {}
    for r in clusters.isolated(df, "k", "ord", 2, f, "y double").orderBy("k", "ord").collect():
        got.setdefault(r.k, []).append(r.y is None)
    assert got == {1: [False] * 6, 2: [True] * 6, 3: [False, False, True, True, False, False]}
    with pytest.raises(Exception, match="KeyError"):
        clusters.isolated(df, "k", "ord", 2, lambda b: b["none"], "y double").collect()


def test_sources(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"ts":"2024-01-01","code":"e1","level":"error","ctx":{"a":"b"}}\nnot json\n{"ts":"x","code":"e2","ctx":"plain"}\n')
    assert {r.code for r in files.jsonl(spark, f"file://{tmp_path}/e.jsonl").collect()} >= {"e1"}
    files.append_events(files.jsonl(spark, f"file://{tmp_path}/e.jsonl").withColumn("ctx", F.create_map(F.lit("text"), F.lit("secret"), F.lit("k"), F.lit("v"))), f"file://{tmp_path}/log")
    assert "secret" not in "".join(p.read_text() for p in (tmp_path / "log").glob("*.json"))
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.json").write_text(json.dumps([{"id": "voice_001", "seconds": 3.0}]))
    (tmp_path / "v/b.json").write_text("{broken")
    from pyspark.sql import types as T

    good, bad = files.json_lists(spark, f"file://{tmp_path}/v", T.StructType().add("id", T.StringType()).add("seconds", T.DoubleType()))
    assert rows(good) == [("voice_001", 3.0)] and bad.count() == 1
    (tmp_path / "s.f32").write_bytes(np.array([[0.5, 0.25]], "<f4").tobytes())
    assert rows(files.sidecar(spark, f"file://{tmp_path}/s.f32").select("block", "mic_rms", "sys_rms")) == [(0, 0.5, 0.25)]


def test_unfilled_template_fails(spark):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(Exception, match="unfilled"):
        df.select(files.templated(df, "{{a}} {{b}}", ["a"])).collect()


def test_heading(spark):
    n = spark.createDataFrame([("a.md", "# A\n## Todo\nold\n## Other\nx"), ("b.md", "text")], "note string, content string")
    new = spark.createDataFrame([("a.md", "Todo", 1, "- one"), ("a.md", "Todo", 2, "- two"), ("b.md", "Todo", 1, "- b"), ("c.md", "Todo", 1, "- c")], "note string, section string, ord int, line string")
    assert dict(export.under_heading(n, new).collect()) == {"a.md": "# A\n## Todo\n- two\n- one\nold\n## Other\nx", "b.md": "text\n## Todo\n- b", "c.md": "## Todo\n- c"}


def test_signals(spark):
    df = spark.createDataFrame([([0.5, -0.5, 0.5, -0.5], [1.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(signal.rms(F.col("a")), signal.gained(F.col("a")), signal.fitted(F.col("a"), 6), signal.mixed(F.col("a"), F.col("b"))).first()
    assert r[0] == 0.5 and r[1] == pytest.approx([0.1, -0.1, 0.1, -0.1]) and r[2] == [0.5, -0.5, 0.5, -0.5, 0.5, -0.5] and len(r[3]) == 4


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-01T10:00:00Z",), ("2024-01-01 10:00",), ("x",)], "t string")
    assert [r[0] for r in df.select(checks.iso_epoch(F.col("t"))).collect()] == [1704067200, 1704103200, 1704103200, None]
    d = spark.createDataFrame([(datetime(2024, 1, 3, 5, 6),)], "t timestamp")
    assert d.select(checks.moment_format(F.col("t"), "DD/MM/YYYY [x]")).first()[0] == "2024-01-03"
    assert d.select(checks.moment_format(F.col("t"), "DD/MM/YYYY HH:mm")).first()[0] == "03/01/2024 05:06"


def test_a_large_bank_whose_id_repeats_is_dealt_to_all_blocks(spark):
    rows = [(7, [i % 5 / 100, 0.01, i / 300]) for i in range(300)] + [(8, [1.0, 0.0, 0.0])]
    bank = spark.createDataFrame(rows, "id long, centroid array<double>").repartition(3)
    sizes = [len(r.y) for r in vectors.packed(bank.select(F.col("id").alias("y"), F.col("centroid").alias("v")), 8, "yf", "y").collect()]
    assert sum(sizes) == 301 and max(sizes) < 100
    probes = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0])], "p long, v array<double>")
    few, many = ({r.p: (r.nearest, round(r.cosine, 6)) for r in vectors.nearest(probes, bank.withColumnRenamed("id", "l"), "p", "v", "l", most, 32).collect()} for most in (4096, 10))
    assert few == many and few[1][0] == 8 and few[2][0] == 7


def test_fold_cuts_keys_from_sorted_rows(spark):
    """Keys that lie across batches, null ones and long ones; a key is no group of its own in the plan."""
    import random

    r = random.Random(4)
    rows = [(k, i, r.random()) for k in [None, *range(-3, 30), (1 << 53) + 1, (1 << 53) + 2] for i in range(r.choice([1, 2, 9, 40]))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "m long, ord long, x double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = folds.fold(df, "m", ["ord"], lambda p: p[["ord"]].assign(y=p["x"].cumsum(), n=range(len(p))), "m long, ord long, y double, n long")
        got = sorted(((g.m, g.ord, round(g.y, 6), g.n) for g in out.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(((k, i, round(sum(x for q, j, x in rows if q == k and j <= i), 6), i) for k, i, _ in rows), key=str)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_isolated_batches_share_groups(spark):
    """Batches of one group fail apart; whole numbers beside nulls stay exact; a group is many batches."""
    def f(b):
        if (b["ord"] == 5).any():
            raise clusters.BatchFailed("five")
        return b.assign(y=b["ord"] + (1 << 53))

    out = clusters.isolated(spark.range(2000).selectExpr("1 k", "id ord"), "k", "ord", 2, f, "y long")
    assert {r.ord: r.y for r in out.collect()} == {k: None if k in (4, 5) else k + (1 << 53) for k in range(2000)}
    assert "__block" in out._jdf.queryExecution().toString()


def test_votes_are_dealt_to_all_partitions(spark):
    """Few bytes, many rows: they don't meet in one task."""
    spans = spark.range(200).selectExpr("id m", "id lid", "0D start", "9D end")
    windows = spark.range(200).selectExpr("id m", "1D start", "2D end", "1 label")
    for votes in (intervals.majority(spans, windows, ["m"]), intervals.weighted(spans, windows, ["m"])):
        assert votes.rdd.getNumPartitions() == 4


def test_grid_vote_is_dealt_to_all_partitions(spark):
    """Users stay in four partitions, however few bytes they are."""
    from speechframe.queries import QUERIES

    assert QUERIES["w10_grid_vote"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
