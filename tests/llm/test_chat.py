"""Preference examples against a plain loop."""

import pytest

from speechframe.llm.chat import preference_examples


def brute(rows):
    out = {}
    for pair in {r[0] for r in rows if r[0] is not None}:
        sides = [sorted([(r[2] is not None, r[2] or 0, r[3] or "unknown", r[4] or "") for r in rows if r[0] == pair and r[1] is c]) for c in (True, False)]
        sides = [[x[2:] for x in s] for s in sides]
        n = 0
        while n < min(map(len, sides)) and sides[0][n] == sides[1][n]:
            n += 1
        show = lambda t: f"<|{t[0]}|>\n{t[1]}<|end|>\n"
        text = lambda s: "".join(map(show, s))
        mask = lambda s: ",".join(f"{len(show(t))}:{int(t[0] == 'assistant')}" for t in s)
        a, b = sides
        out[pair] = (text(a[:n]), n, text(a[n:]), mask(a[n:]), text(b[n:]), mask(b[n:]), bool(a) and bool(b))
    return out


U, A = "user", "assistant"


@pytest.mark.parametrize("rows", [
    [],
    [(1, True, 0, U, "hi"), (1, True, 1, A, "yes"), (1, False, 0, U, "hi"), (1, False, 1, A, "no"), (1, False, 2, U, "why")],
    [(1, True, 0, U, "é"), (1, False, 0, U, "é")],
    [(1, True, 0, U, "only")],
    [(2, True, 0, U, "a"), (2, True, 0, U, "a"), (2, False, 0, U, "a"), (2, False, 3, A, "z")],
    [(3, True, None, None, None), (3, False, None, None, None), (3, True, 5, A, "x" * 100_000), (None, True, 0, U, "lost")],
])
def test_like_a_loop(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "pair_id long, chosen boolean, turn long, role string, text string, pos int")
    assert {r[0]: tuple(r[1:]) for r in preference_examples(df).collect()} == brute(rows)


def test_negative_conversations_pair_with_their_neighbour(spark, tmp_path):
    from compare import connection
    from speechframe.llm.chat import ORACLE_SQL
    from speechframe.llm.queries import QUERIES

    spark.createDataFrame([(c, 0, "user", f"t{c}") for c in range(-4, 4)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op2_preferences"](spark, str(tmp_path))
    assert sorted((r.pair_id, r.complete) for r in got.collect()) == [(k, True) for k in range(-2, 2)]
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, got.select("pair_id", "chosen", "rejected").collect())) == sorted(c.sql(f"SELECT pair_id, chosen, rejected FROM ({ORACLE_SQL})").fetchall())
