"""Comparison of a query's rows with DuckDB's, whatever their order."""

import os

import duckdb

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows_of(columns, rows):
    order = [columns.index(k) for k in sorted(columns)]
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def same(df, c, sql):
    r = c.sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    assert rows_of(df.columns, [tuple(x) for x in df.collect()]) == rows_of(r.columns, r.fetchall())


#: Keys of the tables, and what is added to them in the second copy of `doubled`.
KEYS = {
    "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "events": ["event_id", "user_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id"],
}
SHIFT = 1_000_000


def doubled(sf, to):
    """The tables with a copy of themselves under other keys, so that a query that leaves out large ones is seen."""
    c = connection(sf)
    for t in TABLES:
        again = ", ".join(f"{k} + {SHIFT} AS {k}" for k in KEYS.get(t, []))
        more = f" UNION ALL SELECT * REPLACE ({again}) FROM {t}" if again else ""
        c.execute(f"COPY (SELECT * FROM {t}{more}) TO '{to}/{t}.parquet' (FORMAT parquet)")
    return str(to)
