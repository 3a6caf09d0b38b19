"""Connected components of an edge table, without a group in one task.

Edges (a, b) with a > b point from larger to smaller ids.  Each round hooks
every node to its smallest neighbour and then lets neighbours of a node meet
at that smallest one (alternating large-star and small-star steps), until no
edge changes.  Minima are aggregates with map-side combine; the joins that
hand a minimum to a node's edges are plain equi-joins, which adaptive
execution splits where one node has many edges.  Every round is written to
the session's checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilibra.session import cut_lineage

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a > b)."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(low, "a")
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge with the smallest node it reaches.  Roots map to themselves only
    implicitly: a node absent from the result is its own root."""
    cur = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where(F.col("a") != F.col("b")).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        nxt = cut_lineage(_star(_star(cur, True), False))
        # the edge table is stable once its counts and hash sums repeat
        row = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        cur = nxt
        if row == state:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = row
    raise RuntimeError("components did not settle")
