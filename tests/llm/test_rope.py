"""Ropes against slices of token lists, and exact round trips."""

import random
import re

import pytest

from speechframe.llm import rope
from speechframe.llm.queries import QUERIES

PIECES = ["a", "Zoë", " ", "\n", "\t ", "日本", "　", "\x85", "<", ">", "<P", "P>", "S>", "<M", "word", "😀", "é", "\x00"]


def texts(n=400, seed=7):
    r = random.Random(seed)
    yield from ("", " ", "\n\n", "one", " one", "one ", "<P>", "a<S>b", "x" * 5000, "x " * 5000)
    for _ in range(n):
        yield "".join(r.choices(PIECES, k=r.choice([1, 3, 20, 300])))


@pytest.mark.parametrize("rate", [0, 100])
def test_like_slices(rate):
    r = random.Random(1)
    for t in texts():
        draw = tuple(r.randrange(2**32) for _ in range(4))
        n, form, pre, mid, out = rope.rearranged(t, draw, rate, 50)
        units = re.findall(rope.UNIT, t)
        assert n == len(units) and "".join(units) == t
        a, b = sorted((draw[0] % (n + 1), draw[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or any(x in t for x in rope.SENTINELS) or not rate:
            assert (form, pre, mid, out) == ("plain", None, None, t)
        else:
            assert (pre, mid) == (len(p), len(m))
            assert out == (f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")
        assert rope.restored(out, form) == t


def test_trees_cache_what_they_hold():
    r = random.Random(2)
    for t in texts(100):
        root = rope.build(t)
        todo = [root] if root else []
        while todo:
            x = todo.pop()
            text = rope.flat(x)
            assert x.points == len(text) and x.units == len(re.findall(rope.UNIT, text))
            todo += [c for c in (x.left, x.right) if c]
        if root:
            for by in (rope.UNITS, rope.POINTS):
                k = r.randrange(getattr(root, by) + 1)
                a, b = rope.split(root, k, by)
                assert rope.flat(a) + rope.flat(b) == t and (getattr(a, by) if a else 0) == k


def test_cut_leaves_count_their_units():
    root = rope.build("ab cd ef")
    a, b = rope.split(root, 4, rope.POINTS)
    assert (rope.flat(a), a.units, rope.flat(b), b.units) == ("ab c", 2, "d ef", 2)


def test_odd_tables(spark, docs):
    rows = [(None, None), (None, "a b c"), (1, ""), (1, ""), (2, "the quick brown fox " * 20_000), (3, "a <P> b"), *[(k, f"one two three {k}") for k in range(10, 60)]]
    for some in ([], rows):
        df = docs(some).withColumnRenamed("payload", "output").withColumnRenamed("key", "N")
        got = rope.digests(rope.restore(rope.fill_in_middle(df).drop("text"))).collect()
        assert len(got) == len(some)
        import hashlib

        want = sorted((i is not None, i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in some)
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.restored_sha256) for r in got) == want
        assert {r.form for r in got if r.doc_id in (1, 3)} <= {"plain"}
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_rates(spark, tmp_path):
    spark.createDataFrame([(k, "a b c d") for k in range(4000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n = {r.form: r["count"] for r in QUERIES["op12_fill_in_middle"](spark, str(tmp_path)).groupBy("form").count().collect()}
    assert abs(n["plain"] / 4000 - 0.5) < 0.04 and abs(n["spm"] / (n["spm"] + n["psm"]) - 0.8) < 0.04
