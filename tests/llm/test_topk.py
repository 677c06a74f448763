"""Top-k against a full sort, with ties, hot vectors and small blocks."""

import math

import numpy as np
import pytest

from speechframe.llm import topk


LONGEST = 2**63 - 1


def brute(rows, k):
    usable = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % 20 == 0}):
        qv = min(v for i, v in usable if i == q)
        s = sorted(((-max(-LONGEST, min(LONGEST, sum(a * b for a, b in zip(qv, v)))), i) for i, v in usable if i != q and len(v) == len(qv)))[:k]
        out += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return out


@pytest.mark.parametrize("n,dim,block,scale", [(0, 4, 8, 1), (1, 4, 8, 1), (15, 4, 8, 1), (300, 8, 37, 1), (300, 3, 50, 1e6), (90, 3, 50, 1e7), (90, 3, 20, 1e9), (60, 2, 20, 1e30), (200, 2, 20, 1e-3)])
def test_like_a_sort(spark, monkeypatch, n, dim, block, scale):
    monkeypatch.setattr(topk, "QUERY_ROWS", block)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", block)
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=dim) * scale]) for i in range(n)]
    rows = [(i, rows[1][1]) if i % 3 == 1 else (i, v) for i, v in rows]  # a third of the vectors are one
    if n > 20:
        rows += [(1000, None), (1020, [None] * dim), (1040, [math.nan] * dim), (1060, [math.inf] * dim), (None, [0.5] * dim), (2000, [0.5] * (dim + 1))]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, v string")
    v = topk.quantised(df, "vec_id", "embedding")
    got = topk.top_k(v.where("vec_id % 20 = 0"), v, 7).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 7)


def test_repeated_query_ids_do_not_depend_on_the_order(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.5, 0.5]), *[(i, [i / 7, 3.0 - i]) for i in range(1, 15)], *[(3, [0.25, 0.25])] * 40]
    for some in (rows, rows[::-1]):
        v = topk.quantised(spark.createDataFrame(some, "vec_id long, embedding array<double>"), "vec_id", "embedding")
        got = topk.top_k(v.where("vec_id % 20 = 0"), v, 7).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 7)


def test_huge_components_are_exact(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [0.0, 5.0]), (4, [1e-30, 3.0]), (5, [1e307, 0.0]), (6, [1e12, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v.where("vec_id % 20 = 0"), v, 7).orderBy("rank").collect()]
    assert got == brute([r for r in rows if r[0] != 5], 7)
