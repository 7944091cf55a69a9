"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_totals, written


def _stars(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """Link the neighbours of each node (larger ones, or the others and itself) to the least of them.

    The least neighbour is aggregated before the join, and that of a hub meets its edges where they are.
    """
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if large:
        both = edges.unionByName(back)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n_of_key"))
        return join_totals(both.where("b > a"), least, "a", 2 * n_edges).select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = edges.where("a > b").unionByName(back.where("a > b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n_of_key"))
    others = join_totals(down, least, "a", 2 * n_edges).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node in the links ``a``, ``b`` (longs). Self-links and repeats do no harm."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state, n = None, edges.count()
    while n:
        larger = written(_stars(edges, True, n).where("a <> b").distinct(), "stars")
        edges = written(_stars(larger, False, larger.count()).where("a <> b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, n = now, now[0]
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
