"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut_lineage, spread_join


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b long); component is the smallest node reachable.

    Each step replaces links by links to a smaller node; a star per component is
    left after a number of steps that grows with the logarithm of the longest
    path.  A node's smallest neighbour is a pre-aggregated minimum that is joined
    back, with the neighbours of a node that has very many dealt to parts.  An
    empty table gives none.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, most = None, 2 * edges.count()
    while True:
        # Large star: every larger neighbour of u is linked to u's smallest neighbour (or u itself).
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, least, "u", "n", ["v"], most=most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large) if most > common.PART_ROWS else large  # read twice only then
        # Small star: every smaller neighbour of u, and u itself, is linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        linked = F.when(F.col("v") == F.col("m"), F.struct(F.col("u"), F.col("m").alias("v"))).otherwise(F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut_lineage(spread_join(large, low, "u", "n", ["v"], most=most).select(linked.alias("e")).select("e.*").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before, most = now, 2 * now.n
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("e")).select("e.*").distinct()
