"""Exact top-k vector search by distributed histogram selection.

Every query is scored against every candidate, block by block.  Per query a
histogram of the scores is summed over all candidate blocks and refined until
the k-th best score is known exactly; a last pass keeps what reaches it and
breaks ties by the smaller id.  Memory per task is one query block times one
candidate block; nothing depends on how many vectors are equal.

Defined results: a vector that is null, or holds a null or non-finite
component (before or after scaling), takes no part on either side; vectors of
different lengths score nothing against each other; with fewer than k
candidates all are returned; an empty table gives no rows.  Repeated ids are
separate candidates, and a row is never its own query's candidate (all rows of
the query's id are left out); of rows that repeat a query's id the one whose
vector sorts first asks.  Scores are exact at any magnitude; one beyond 64 bits
is returned as the nearest 64-bit integer, and ties with others beyond it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_lineage, map_arrow, schema

#: Rows of a query block and of a candidate block; bins of a histogram.
QUERY_ROWS, CANDIDATE_ROWS, BINS = 4096, 4096, 512
EXACT = 2.0**53
LONGEST = (1 << 63) - 1


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: float = 64.0) -> DataFrame:
    """(vec_id, v array<double>) of whole numbers floor(scale * x); unusable vectors go."""
    scaled = F.transform(F.col(vec_col), lambda c: c.cast("double") * F.lit(scale))
    v = F.transform(scaled, lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y))  # beyond, doubles are whole
    bad = F.exists(scaled, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == F.lit(math.inf)))
    usable = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(False))
    return df.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(name)
    flat = np.asarray(lists.flatten())
    return np.diff(np.asarray(lists.offsets)), flat


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, float BLAS where no partial sum can round."""
    top = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    if top < 2.0**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if top < EXACT:
        return (q @ c.T).astype(np.int64)
    if top < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda x: np.array([int(y) for y in x.ravel()], dtype=object).reshape(x.shape)  # noqa: E731  Python's unbounded integers
    return np.clip(whole(q) @ whole(c).T, -LONGEST, LONGEST).astype(np.int64)


def _blocks(df: DataFrame, n: int) -> DataFrame:
    """Candidates packed into about n/CANDIDATE_ROWS blocks, dealt by the row's place in the input (an id may repeat in many rows): (cb, dim, cids, cflat)."""
    b = max(1, math.ceil(n / CANDIDATE_ROWS))
    return df.groupBy(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(b)).cast("int").alias("cb"), F.size("v").alias("dim")).agg(
        F.collect_list(F.struct("vec_id", "v")).alias("rows")).select("cb", "dim", F.col("rows.vec_id").alias("cids"), F.flatten("rows.v").alias("cflat"))


def _pairs(df: DataFrame, out: str, f) -> DataFrame:
    kind = schema(out)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                arr = lambda n: np.asarray(row[n].values)
                qids, cids, dim = arr("qids"), arr("cids"), row["dim"].as_py()
                q = arr("qflat").reshape(len(qids), dim)
                c = arr("cflat").reshape(len(cids), dim)
                for lo in range(0, len(qids), 512):
                    s = _scores(q[lo : lo + 512], c)
                    own = qids[lo : lo + 512, None] == cids[None, :]
                    low = arr("lo")[lo : lo + 512] if "lo" in row else None
                    width = arr("width")[lo : lo + 512] if "width" in row else None
                    columns = f(qids[lo : lo + 512], cids, s, own, low, width)
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(columns, arrow)], schema=arrow)

    return map_arrow(df, run, kind)


def _histogram(k: int):
    def f(qids, cids, s, own, low, width):
        """Counts of the BINS bins above low (the last is open at the top), from the top until k are seen."""
        ok = ~own & (s >= low[:, None])
        above_low = s.view(np.uint64) - low.view(np.uint64)[:, None]  # never wraps where ok
        bins = np.minimum(above_low // width.astype(np.uint64)[:, None], BINS - 1).astype(np.int64)
        key = (np.arange(len(qids), dtype=np.int64)[:, None] * BINS + bins)[ok]
        counts = np.bincount(key, minlength=len(qids) * BINS).reshape(len(qids), BINS)
        above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts  # in higher bins
        i, b = np.nonzero((counts > 0) & (above < k))
        return qids[i], b.astype(np.int32), counts[i, b]

    return f


def _keep(k: int):
    def f(qids, cids, s, own, low, width):
        """What reaches the k-th score; of it at most k a block, the best by (score, smaller id)."""
        ok = ~own & (s >= low[:, None])
        i, j = np.nonzero(ok)
        score = s[i, j]
        order = np.lexsort((cids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, np.arange(len(qids)))
        keep = np.arange(len(i)) - first[i] < k
        return qids[i[keep]], cids[j[keep]], score[keep]

    return f


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """The k best candidates of every query.

    Both inputs: (vec_id long, v array<double> of whole numbers), as
    ``quantised`` makes them.  Returns (query_id, rank from 1, vec_id, score).
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    stats = candidates.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    n_q = queries.count()
    cand = cut_lineage(_blocks(candidates, stats.n or 0))
    norm = math.sqrt(stats.m or 0.0)
    # By Cauchy-Schwarz every score of a query lies in [-reach, reach]; the slack covers the rounding of the norms.
    most = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) * F.lit(norm) * F.lit(1 + 1e-9)
    reach = F.when(most < 9e18, F.ceil(most).cast("long") + 1).otherwise(F.lit(LONGEST))
    known = queries.select("vec_id", "v", reach.alias("r")).select("vec_id", "v", (-F.col("r")).alias("lo"), F.expr(f"r div {BINS // 2} + 1").alias("width"), F.lit(False).alias("done"))
    known = cut_lineage(known)
    b = max(1, math.ceil(n_q / QUERY_ROWS))

    c = max(1, math.ceil((stats.n or 0) / CANDIDATE_ROWS))

    def joined(state: DataFrame) -> DataFrame:
        """One row per (query block, candidate block) of equal dimension; the grid's cells are spread by hash."""
        packed = state.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(b)).cast("int").alias("qb"), F.size("v").alias("dim")).agg(F.collect_list(F.struct("vec_id", "v", "lo", "width")).alias("r")).select(
            "qb", "dim", F.col("r.vec_id").alias("qids"), F.flatten("r.v").alias("qflat"), F.col("r.lo").alias("lo"), F.col("r.width").alias("width"))
        left = packed.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
        right = cand.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
        return left.join(right, ["qb", "cb", "dim"])

    while not known.where("not done").isEmpty():
        counts = _pairs(joined(known), "query_id long,bin int,n long", _histogram(k)).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        # The highest bin at which k are reached; the lowest filled bin if there are fewer.
        total = counts.withColumn("upto", F.sum("n").over(w))
        at = total.groupBy("query_id").agg(F.max(F.when(F.col("upto") >= k, F.col("bin"))).alias("hit"))
        # Bins from here on are one wide where the width was one: the k-th score is then known.
        # The sum is taken in four steps, none of which leaves 64 bits.
        quarter = F.expr("(hit div 4) * width")
        known = known.join(at.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select(
            "vec_id", "v",
            F.when(F.col("done") | F.col("hit").isNull(), F.col("lo")).otherwise(F.col("lo") + quarter + quarter + quarter + F.expr("(hit - 3 * (hit div 4)) * width")).alias("lo"),
            F.when(F.col("done") | F.col("hit").isNull(), F.col("width")).otherwise(F.ceil(F.col("width") / F.lit(BINS)).cast("long")).alias("width"),
            (F.col("done") | F.col("hit").isNull() | (F.col("width") == 1)).alias("done"))
        known = cut_lineage(known)

    best = _pairs(joined(known), "query_id long,vec_id long,score long", _keep(k))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
