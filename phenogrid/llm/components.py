"""Connected components by distributed union-find in alternating star steps.

Each round hooks larger neighbours of a node, then smaller ones, onto the smallest node seen.
Rounds end when nothing changes, that is, when every node points straight at its root. Edges are
staged between rounds, so lost executors cost one round at most, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage, unstage


def _state(edges: DataFrame) -> tuple:
    # exact sum of a hash in two halves: no overflow for any number of edges that fits a table
    h = F.xxhash64("a", "b")
    row = edges.agg(
        F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of one orderable type to ``(node, root)`` for every node with an edge;
    the root is the smallest node reachable, and has a row of its own.

    Direction, repetition and loops of edges do not matter; edges with a NULL end are no edges.
    No edges give no rows. A node with very many edges is one key of a join, which Spark can split.
    """
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    now = stage(edges.where("a != b").select(high, low).distinct())  # a > b
    before = _state(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = now.select(F.col("b").alias("u"), F.col("a").alias("v"))  # neighbours above u
        large = up.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        done = stage(small.distinct())
        unstage(now)
        now, state = done, _state(done)
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
