"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialise, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect the larger (or the not larger) neighbours of each node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    kept = both if large else both.where("b <= a")
    least = kept.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("least"))
    joined = kept.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a != b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable. Edges (a, b); loops and repeats are allowed.

    Every round is written to the shared folder, where it replaces the one before; the number of rounds grows with the
    logarithm of the longest path. No edges give no rows.
    """
    current = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        before, current = current, materialise(_star(_star(current, True), False), "stars")
        release(before)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
