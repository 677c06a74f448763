"""The mix against plain loops: targets, words taken, positions by integration in small steps."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from speechframe.llm import curriculum
from speechframe.llm.curriculum import SCHEDULES, by_document, mix, time_of, training_order

COLS = "doc_id long, text string, source string, size long, position string"


def water(sizes, weights, budget, most):
    """Shares out what is left until no source is above its cap."""
    full, left = {}, budget * sum(sizes.values())
    while True:
        open_ = [k for k in sizes if k not in full]
        got = {k: left * weights[k] / sum(weights[x] for x in open_) for k in open_}
        over = [k for k in open_ if got[k] > most * sizes[k]]
        if not over:
            return full | got
        for k in over:
            full[k] = most * sizes[k]
            left -= full[k]


def brute(rows, budget=1.5, most=2):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = Counter({s: 0 for s in order})
    for r in rows:
        sizes[r[2]] += size(r[1])
    goal = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, budget, most)
    out = []
    for s in order:
        at = 0
        for d, n in sorted(((r[0], size(r[1])) for r in rows if r[2] == s), key=lambda x: (hashlib.md5(str("" if x[0] is None else x[0]).encode()).hexdigest(), x[0] is not None, x[0] or 0, x[1])):
            taken = sum(max(0, min(n, int(goal[s]) - at - k * sizes[s])) for k in range(most))
            out.append((d, n, sizes[s], round(goal[s], 6), taken))
            at += n
    return sorted(out, key=repr)


WORDS = "a bb ccc "
ODD = [
    [],
    [(1, "one two", "s", None, None)],
    [(None, None, None, 1, "x"), (None, "a b", None, 1, "x"), (1, "", "b", 1, "x"), (1, "a b c", "b", 1, "x"), (1, "a b c", "b", 1, "x"), (2, "　x y z", "", 1, "x"), (3, "w " * 50_000, "c", 1, "x")],
    [(k, WORDS * (k % 5), f"s{min(k % 7, 3)}", 0, "") for k in range(300)],
    [(k, WORDS, "hot" if k % 3 else f"s{k}", 0, "") for k in range(200)],
    [(1, None, "a", 0, ""), (2, "", None, 0, "")],
]


@pytest.mark.parametrize("rows", ODD)
def test_like_a_loop(spark, rows):
    got = by_document(mix(spark.createDataFrame(rows, COLS))).drop("position").collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=repr) == brute(rows)


def test_words_meet_targets_and_no_document_is_above(spark):
    rows = [(k, "w " * (k % 40), f"s{k % 9 if k % 3 else 0}", 0, "") for k in range(2000)]
    got = by_document(mix(spark.createDataFrame(rows, COLS))).collect()
    source = {r[0]: r[2] for r in rows}
    taken, goal = Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size
    assert all(goal[s] - 1 < taken[s] <= goal[s] for s in goal) and abs(sum(goal.values()) - 1.5 * sum(k % 40 for k in range(2000))) < 1e-6


def test_positions_are_the_inverse_of_the_integral(spark):
    for knots in (*SCHEDULES, ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (1.0, 4.0))):
        total = curriculum.integrals(knots)[-1]
        areas = [total * k / 64 for k in range(65)]
        got = [r[0] for r in spark.createDataFrame([(a,) for a in areas], "a double").select(time_of(F.col("a"), knots)).collect()]
        steps, done, want, at = 200_000, 0.0, [], 0
        weight = lambda t: next(w + (x - w) * (t - a) / (b - a) for (a, w), (b, x) in zip(knots, knots[1:]) if t <= b)
        for k in range(steps):
            while at < 65 and areas[at] <= done + 1e-9:
                want.append(k / steps)
                at += 1
            done += weight((k + 0.5) / steps) / steps
        want += [1.0] * (65 - len(want))
        assert max(abs(a - b) for a, b in zip(got[1:-1], want[1:-1])) < 3e-3, knots


def test_sources_share_time_as_their_schedules_say(spark):
    """Of a source that fades the first half of training has more words, of one that grows fewer, in the ratio of the integrals."""
    docs = spark.createDataFrame([(k, WORDS, f"s{k % 3}", 0, "") for k in range(6000)], COLS)
    early = Counter()
    rows = training_order(mix(docs, budget=0.4)).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and all(0 <= r.position < 1 for r in rows)
    everything = Counter()
    for r in rows:
        everything[r.source] += r.words
        early[r.source] += r.words if r.position < 0.5 else 0
    for s, share in {"s0": 1.75 / 3, "s1": 0.5, "s2": 0.75 / 2}.items():
        assert abs(early[s] / everything[s] - share) < 0.01, s


def test_chosen_schedules_and_no_weight(spark):
    docs = spark.createDataFrame([(k, "w", "ab"[k % 2], 0, "") for k in range(100)], COLS)
    none = ((0.0, 0.0), (1.0, 0.0))
    got = mix(docs, schedules=(SCHEDULES[1], none), choose=F.when(F.col("key") == "0a", 1).otherwise(0), budget=0.5).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert {r.source: r.n for r in got} == {"a": 0, "b": 50}


def test_reruns_and_partitions_agree(spark):
    docs = spark.createDataFrame([(k // 2, WORDS * (k % 3), f"s{k % 4}", 0, "") for k in range(500)], COLS)
    first = sorted(map(repr, by_document(mix(docs.repartition(1))).collect()))
    assert first == sorted(map(repr, by_document(mix(docs.repartition(7, "text"))).collect()))
