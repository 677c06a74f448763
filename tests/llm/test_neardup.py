"""Near-duplicate groups against all pairs, and the sketch's own promises."""

import random

import numpy as np
import pytest

from speechframe.llm import neardup, sketch
from speechframe.llm.components import components


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent=80):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def corpus(seed, base_words, copies, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, doc = [], 0
    for _ in range(4):
        base = [rng.choice(vocabulary) for _ in range(base_words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((doc, " ".join(w)))
            doc += 1
    rows += [(doc + k, " ".join(rng.choice(vocabulary) for _ in range(base_words))) for k in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,words,copies,edits,block", [(1, 60, 12, 8, 256), (2, 200, 40, 24, 7), (3, 30, 30, 5, 4)])
def test_like_all_pairs(docs, monkeypatch, seed, words, copies, edits, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BESIDE", block)
    rows = corpus(seed, words, copies, edits)
    rows += [(1000, rows[0][1]), (1001, rows[0][1].upper()), (1002, None), (1003, ""), (1004, "  "), (1005, "one"), (1006, "ONE "), (1007, "x " * 20_000)]
    got = {r.doc_id: r for r in neardup.groups(docs(rows), 2).collect()}
    want = brute(rows, 2)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingles(t, 2)) for i, t in rows}


def test_nulls_repeats_and_nothing(docs):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None), (3, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.groups(docs(rows), 2).collect()), key=repr)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)], key=repr)
    assert neardup.groups(docs([]), 2).count() == 0
    left = neardup.distinct_documents(docs(rows), 2)
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([None, 1, 1, 3, 3], key=repr) and left.columns == docs([]).columns


def test_an_id_with_several_texts(docs):
    """Rows (5, A) (5, B) (7, A and a word) (9, B and a word), and an id that is the smallest of neither of its sets."""
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(5, a), (5, b), (7, a + " more"), (9, b + " more"), (4, "c d e f"), (6, "c d e f"), (6, a), (20, "z y"), (20, "z y"), (21, "q")]
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.groups(docs(rows), 2).collect()}
    assert got == {(4, 4, True), (5, 4, False), (6, 4, False), (7, 4, False), (9, 4, False), (20, 20, True), (21, 21, True)}


@pytest.mark.parametrize("seed", [11, 12])
def test_repeated_ids_like_all_pairs(docs, monkeypatch, seed):
    from speechframe.llm import common

    monkeypatch.setattr(common, "PART_ROWS", 5)
    rng = random.Random(seed)
    rows = [(rng.randrange(90) if rng.random() < 0.3 else i + 100, t) for i, t in corpus(seed, 40, 12, 6)]
    rows += [(rows[0][0], "lone words"), (rows[0][0], "lone words"), (rows[1][0], rows[0][1])]
    got = neardup.groups(docs(rows), 2).collect()
    want = brute(rows, 2)
    assert sorted((r.doc_id, r.component_id, r.n_shingles) for r in got) == sorted((i, want[i], len(shingles(t, 2))) for i, t in rows)


def test_many_products_give_the_same_intersections(docs, monkeypatch):
    """Over 512 open pairs in a block: sizes come from matrix products."""
    rng = random.Random(9)
    base = [f"v{k}" for k in range(100)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in rng.sample(range(100), 14):
            w[j] = f"z{rng.randrange(10_000)}"
        rows.append((k, " ".join(w)))
    assert {r.doc_id: r.component_id for r in neardup.groups(docs(rows), 1, 75).collect()} == brute(rows, 1, 75)


def test_intersections_of_a_cell_need_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 1 << 64, 12_000, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool, 10_000, replace=False)) for _ in range(200)] + [None, pool[:1]]
    x, y = (a[:1_000] for a in np.triu_indices(200, 1))
    x, y = np.append(x, 0), np.append(y, 201)
    tracemalloc.start()
    got = neardup.intersections(sets, x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [len(np.intersect1d(sets[p], sets[q])) for p, q in zip(x, y)]
    assert peak < 40 << 20  # 109 MB when all 2,000,000 shingles were numbered at once


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 3000, dtype=np.uint64), rng.integers(0, 2**63, 500, dtype=np.uint64)
    one = lambda x: sketch.registers(x, np.zeros(len(x), int), np.array([len(x)]))[0]
    assert (one(np.concatenate([a, b])) == np.maximum(one(a), one(b))).mean() > 0.99
    j = len(a) / (len(a) + len(b))
    assert abs((one(a) == one(np.concatenate([a, b]))).mean() - j) < 0.15


def test_likelihood_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(1)
    for j, keep in ((0.8, True), (0.95, True), (0.3, False)):
        n = 400
        both = int(round(2 * n * j / (1 + j)))
        kept = []
        for _ in range(40):
            e = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            x, y = e[:n], e[n - both :]
            r = sketch.registers(np.concatenate([x, y]), np.repeat([0, 1], n), np.array([n, n]))
            kept.append(sketch.may_reach(0.8, np.array([float(n)]), np.array([float(n)]), r[:1], r[1:])[0])
        assert all(kept) if keep else not any(kept)


def test_hot_groups_are_dealt_to_parts(docs, monkeypatch):
    """A third of the rows are exact copies, a third near copies of one text; parts of a few rows."""
    from speechframe.llm import common

    monkeypatch.setattr(common, "PART_ROWS", 9)
    monkeypatch.setattr(neardup, "BLOCK", 11)
    monkeypatch.setattr(neardup, "BESIDE", 11)
    rng = random.Random(4)
    base = [f"v{k}" for k in range(90)]
    near = []
    for k in range(80):
        w = list(base)
        for j in rng.sample(range(90), rng.randint(0, 9)):
            w[j] = f"z{rng.randrange(10_000)}"
        near.append((1000 - k, " ".join(w)))
    rows = near + [(k, "the same text of every page here") for k in range(80)] + [(2000 + k, f"a{k} b{k} c{k}") for k in range(80)] + [(3000 + k, None) for k in range(20)]
    assert {r.doc_id: r.component_id for r in neardup.groups(docs(rows), 2).collect()} == brute(rows, 2)


def test_components_with_hot_nodes(spark, monkeypatch):
    from speechframe.llm import common

    monkeypatch.setattr(common, "PART_ROWS", 5)
    links = [(0, k) for k in range(1, 200)] + [(1000, k) for k in range(300, 400)] + [(1000, 1001)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(200)}, **{k: 300 for k in [*range(300, 400), 1000, 1001]}}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_a_join(spark, monkeypatch, how):
    from speechframe.llm import common

    monkeypatch.setattr(common, "PART_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    big = [(k % 7 if k % 5 else None, k) for k in range(100)]
    big += [(50, k) for k in range(100)] + [(51, 1)]
    small = [(k, f"s{k}", sum(x == k for x, _ in big)) for k in [*range(5), 50, 99]]
    b, s = spark.createDataFrame(big, "key long, row long"), spark.createDataFrame(small, "key long, v string, n long")
    got = sorted(map(tuple, common.spread_join(b, s, "key", "n", ["row"], how).select("key", "row", "v").collect()), key=repr)
    assert got == sorted(map(tuple, b.join(s.drop("n"), "key", how).select("key", "row", "v").collect()), key=repr)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 300), (7, 7), (500, 400)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 300: 100, 400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
