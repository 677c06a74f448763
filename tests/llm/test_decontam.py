"""Leaks with substitutions are found, clean texts are left alone; both join paths agree."""

import random
import re

import pytest

from speechframe.llm import decontam

W = [a + b for a in "ka lo mi nu pe ra si tu vo ze".split() for b in "bar den fil gor hun jos kel lim mor nat".split()]


def text(rng, n):
    return " ".join(rng.choice(W) + rng.choice(["", ",", "."]) for _ in range(n))


@pytest.fixture
def case(spark, docs):
    rng = random.Random(5)
    items = [(k, text(rng, n)) for k, n in enumerate((20, 35, 13, 60, 8, 3))] + [(9, None), (10, "")]
    words = [re.findall(r"\w+", t or "") for _, t in items]
    rows = [(k, text(rng, 200)) for k in range(40)] + [(100, None), (101, ""), (102, "one two")]
    planted = {}
    for k in range(12):
        item = k % 5
        w = list(words[item])
        for j in rng.sample(range(len(w)), len(w) // 10):  # one word in ten is another
            w[j] = "other"
        t = text(rng, 50) + " " + " ".join(w).upper() + " " + text(rng, 30)
        rows += [(200 + k, t)] * (1 + k % 2)
        planted[200 + k] = items[item][0]
    rows.append((300, text(rng, 20_000) + " " + items[0][1]))
    planted[300] = 0
    return docs(rows), spark.createDataFrame(items, "item_id long, text string"), planted


@pytest.mark.parametrize("broadcast", [True, False])
def test_planted(case, monkeypatch, broadcast):
    d, b, planted = case
    if not broadcast:
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(d, b).collect()}
    assert {x for x in got if x[1] != 5} == set(planted.items())
    left = {r.doc_id for r in decontam.clean(d, b).collect()}
    assert left == {r.doc_id for r in d.collect()} - set(planted) and decontam.clean(d, b).columns == d.columns


def test_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.overlaps(docs([]), none).count() == 0 and decontam.clean(docs([(1, "a b")]), none).count() == 1


def test_every_allowed_substitution_is_hit():
    from itertools import combinations
    from math import ceil

    assert all("0" in m for m in decontam.MASKS)
    for n in range(1, 14):
        for subs in combinations(range(n), n - ceil(n * 0.8 - 1e-9)):
            assert any(all(p + j not in subs for j, c in enumerate(m) if c == "1") for m in decontam.SHORT_MASKS.get(n, decontam.MASKS) for p in range(n - len(m) + 1)), (n, subs)


@pytest.mark.parametrize("broadcast", [True, False])
def test_like_sql_on_short_items_and_repeated_ids(spark, docs, tmp_path, monkeypatch, broadcast):
    """Items of 1 to 15 words, with as many substitutions as 0.8 allows and one more; ids that repeat with other texts, and null ones."""
    import duckdb

    from speechframe.llm.queries import ORACLE_SQL

    if not broadcast:
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    rng = random.Random(11)
    items = [(n, " ".join(rng.choice(W) for _ in range(n))) for n in range(1, 16)] + [(15, text(rng, 9)), (None, text(rng, 8)), (99, None), (98, " !! ")]
    rows = []
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        for subs in range(min(4, len(w) + 1)):
            x = list(w)
            for j in rng.sample(range(len(w)), subs):
                x[j] = "other"
            rows.append((rng.choice([1, 2, 3, 1000 + k, None]), " ".join([text(rng, 15), *x, text(rng, 15)])))
    rows += [(3, items[9][1]), (4, "".join(items[0][1])), (5, None), (6, "")]
    d, b = docs(rows), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontam.overlaps(d, b).select("doc_id", "item_id", "item_words", "matched_words", "window_words").collect()), key=repr)
    c = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", b)):
        df.select(*df.columns[:2]).write.parquet(f"{tmp_path}/{name}")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert got == sorted(c.sql(f"SELECT doc_id, item_id, item_words, matched_words, window_words FROM ({ORACLE_SQL['op3_decontamination']})").fetchall(), key=repr) and len(got) > 20


def test_a_common_word_is_no_leak(spark, docs):
    d, b = docs([(1, "one two"), (2, "three")]), spark.createDataFrame([(1, "one"), (2, "three four")], "item_id long, text string")
    assert decontam.clean(d, b).count() == 2 and decontam.clean(d, b, least_words=1).count() == 1


@pytest.mark.parametrize("broadcast", [True, False])
def test_null_ids_are_compared_and_removed(spark, docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    item = text(random.Random(3), 20)
    d, b = docs([(None, f"some words {item} more"), (1, "clean words"), (2, item)]), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id for r in decontam.overlaps(d, b).collect()} == {None, 2}
    assert [r.doc_id for r in decontam.clean(d, b).collect()] == [1]


@pytest.mark.parametrize("n", [5, 6])
def test_short_items_with_a_substitution(spark, docs, n):
    w = W[:n]
    rows = [(k, " ".join(["before", *w[:k], "other", *w[k + 1 :], "after"])) for k in range(n)] + [(20, " ".join(["other", *w[1:-1], "other"]))]
    b = spark.createDataFrame([(7, " ".join(w)), (8, " ".join(W[50:70]))], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.matched_words) for r in decontam.overlaps(docs(rows), b).collect()} == {(k, 7, n - 1) for k in range(n)}
