"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import written


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every neighbour is linked to the smallest id of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return small.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) for every node of `edges(a, b)` that isn't itself the smallest of its component.

    Null ends, self edges and repeated edges are ignored; no edges give no rows.
    Each round writes its edges to the shared folder, so a lost executor costs
    no more than the round at hand. Rounds grow with the logarithm of the
    longest chain; not converging within `most_rounds` is an error.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = written(edges.where("a is not null and b is not null and a <> b").select(high, low).distinct(), "edges")
    for _ in range(most_rounds):
        # A forest of stars is done: no end is a root and a leaf, and no leaf has two roots.
        leaves = now.groupBy("u").agg(F.count("*").alias("n"))
        roots = now.select(F.col("v").alias("u")).distinct()
        if not leaves.where("n > 1").select("u").union(leaves.join(roots, "u", "left_semi").select("u")).take(1):
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        now = written(_stars(now), "edges")
    raise RuntimeError(f"components did not converge in {most_rounds} rounds")
