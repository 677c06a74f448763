"""Small tables on which queries once differed from their SQL."""

import struct

import duckdb
import pytest

from compare import same
from speechframe.queries import ORACLE_SQL, QUERIES


@pytest.fixture
def alike(spark, tmp_path):
    """Compares a query with its SQL on a table given as a SELECT a file."""

    def run(query, table, *selects):
        c = duckdb.connect()
        c.execute("SET threads = 1")
        (tmp_path / f"{table}.parquet").mkdir()
        for k, select in enumerate(selects):
            c.execute(f"COPY ({select}) TO '{tmp_path}/{table}.parquet/{k}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        same(QUERIES[query](spark, str(tmp_path)), c, ORACLE_SQL[query])

    return run


def orders(*rows):
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, {c}::BIGINT, '{s}', {p}::DOUBLE, TIMESTAMP '{day}', '1-URGENT')" for k, c, s, p, day in rows) + ") t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)"


def test_first_wins_when_keys_pass_a_million(alike):
    """A price that is 0.50 higher, under a key that is worth 0.90 less; equal prices, the later key being the smaller in its million."""
    day = "1997-01-01"
    alike("l7_first_wins", "orders", orders((900_000, 1, "O", 100.5, day), (1_000_001, 1, "O", 100.0, day), (700_000, 2, "O", 9.0, day), (2_000_003, 2, "F", 9.0, day)))


def test_confidence_at_the_threshold(alike):
    """Means of exactly a half, whose sums of doubles fall on either side of it by their order, over several files."""
    a = "30 + (u * u * 7 + (i % 32) * (i % 32) * 13 + u * (i % 32)) % 21"
    rows = f"SELECT u, j, CASE WHEN i < 32 THEN {a} ELSE 100 - ({a}) END AS p FROM (SELECT u, j, (j * 5 + u) % 64 AS i FROM range(300) u(u), range(64) j(j))"
    alike("p16_confidence_gate", "events", *[f"""SELECT j * 100 + p * 73 % 100 AS event_id, TIMESTAMP '2024-01-01' AS ts, u AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props
        FROM ({rows}) WHERE j // 16 = {k} ORDER BY ALL""" for k in range(4)])


def test_dissolved_into_a_window_at_the_same_time(alike):
    """Event 23 is of a minor label and of the same centre as 14, which comes before it in order."""
    at = [(14, 0), (23, 0), *((30 + 9 * k, 8192 + k) for k in range(12)), *((32 + 9 * k, 81920 + k) for k in range(12))]
    alike("v14_dissolved", "events", "SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, TIMESTAMP '2024-01-01' + to_seconds({x}), 1::BIGINT, 'view', 1.0::DOUBLE, '{{}}')" for k, x in at) + ") t(event_id, ts, user_id, event_type, value, props)")


def test_entries_that_tie(alike):
    """Of entries of one state, day and last two digits the one that comes first."""
    rows = [(100 * k + 7, k % 3, "OF"[k % 2], 1.0, "1997-01-0" + "12"[c]) for k, c in zip(range(60), [0, 1, 1] * 20)]
    alike("s9_active_entry", "orders", orders(*rows))


def documents(*texts):
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{x}', 'src1')" for k, x in enumerate(texts)) + ") t(doc_id, text, source)"


SHARP = ["ßa. ßb! ßc\nßd", "ﬁn. ﬁn", "ᾳ. ᾳ", "ŉ a. éa", "ΐ", "ÿ. ÿ", "", "a? ß"]


def test_capitals_of_one_letter(alike):
    alike("t5_capitals", "documents", documents(*SHARP))


def test_formatted_capitals_of_one_letter(alike):
    alike("t6_formatted", "documents", documents(*SHARP))


#: White space and letters that Java's Unicode classes know and the SQL's don't, titlecase letters, i without and with its dot, and the SQL's own marks.
ODD = ["fin.\xa0euh bon", "a. \u2028b", "fin.\x0bdonc x\x0b", "\u3000x \x85", "euh\u0301 x", "\u03b1euh\u03b1 x", "x\u00d7euh", "heın, HEİN a", "TU VOIſ", "voılà, x", "ǆa", "ǅa", "\x01euh\x02 bon", "x\x01\n\n\n", "tu\x02 vois", "ẞeuh", "a euh,\xa0,b\u2003"]


@pytest.mark.parametrize("query", ["t6_formatted", "t3_fillers", "t4_spacing"])
def test_signs_that_engines_class_otherwise(alike, query):
    alike(query, "documents", documents(*ODD))


def test_a_note_holds_every_document_of_its_source(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT i AS doc_id, 'x' AS text, 'src' || i % 2 AS source FROM range(1000) r(i)) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    got = {r.note: r.content for r in QUERIES["k13_under_heading"](spark, str(tmp_path)).collect()}
    assert got == {f"src{k}": "\n".join(["## Docs", *(f"- {i}" for i in range(998 + k, -1, -2)), "old"]) for k in (0, 1)}


def test_windows_carry_their_own_words_only(spark, tmp_path):
    from speechframe.plans.text import windows

    duckdb.sql(f"COPY (SELECT 1 AS doc_id, string_agg('w' || chr(97 + CAST(i % 26 AS INT)), ' ' ORDER BY i) AS text FROM range(1000) r(i)) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    words = ["w" + chr(97 + i % 26) for i in range(1000)]
    got = {r.i: r.x for r in windows(spark, str(tmp_path), "[^a-z ]+").collect()}
    assert got == {i: words[14 * i : 14 * i + 40] for i in range(72)}


def test_blocks_of_neighbours_are_bounded_in_number(spark, monkeypatch):
    """Copies of a row are as many as blocks, which don't grow with the rows; ties in and across blocks go to the smaller id."""
    from speechframe.operators import vectors

    monkeypatch.setattr(vectors, "BLOCKS", 4)
    seen, best_of = [], vectors.best_of
    monkeypatch.setattr(vectors, "best_of", lambda left, right, p, n, m: seen.append((n, m)) or best_of(left, right, p, n, m))
    vs = [[float(k % 5 == 0), float(k % 5 == 1), (k % 7) / 7] for k in range(300)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vs)], "vec_id long, embedding array<float>")
    got = {(r.x, r["rank"]): r.y for r in vectors.neighbours(df, "vec_id", "embedding", 3, block=10).collect()}
    assert seen == [(4, 4)]
    f = [[struct.unpack("f", struct.pack("f", a))[0] for a in v] for v in vs]
    for x in range(300):
        ranked = sorted((y for y in range(300) if y != x), key=lambda y: (-round(sum(a * b for a, b in zip(f[x], f[y])), 9), y))
        assert [got[x, k] for k in (1, 2, 3)] == ranked[:3]
