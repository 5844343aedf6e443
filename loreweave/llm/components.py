"""Connected components of a table of edges, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long): the smallest node that each reaches.

    Alternates large-star and small-star steps: every node hangs its larger
    neighbours, then its smaller ones, on the smallest node it knows.  The rounds
    grow with the logarithm of the number of nodes; each round's edges are
    written to the shared folder, so lineage stays short.  Hubs lose their edges
    to a pre-aggregated minimum instead of a collected group.
    """
    near = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        large = star(near, smaller=False)
        near = stored(star(large, smaller=True))
        now = near.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return near.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        near.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def star(near: DataFrame, smaller: bool) -> DataFrame:
    """One step over edges with a > b: of all nodes' neighbours, or of the smaller ones, to the least of them."""
    ways = near if smaller else near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = ways.join(least, "a")
    kept = joined.where("b <> m") if smaller else joined.where("b > a")
    out = kept.select(F.col("b").alias("x"), F.col("m").alias("y"))
    if smaller:
        out = out.unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
