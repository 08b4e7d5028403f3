"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.store import drop, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: hang neighbours on the least id that a vertex sees."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = down.union(down.select(F.col("v"), F.col("u"))) if large else down
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = near.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b")


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex hangs on one other at most, which hangs on none."""
    down = edges.select(F.greatest("a", "b").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    up = edges.select(F.least("a", "b").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    return down.union(up).groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs + holds > 1 and hangs > 0").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the least id reachable.

    Alternates large-star and small-star steps until every vertex hangs on the
    least of its component, which takes a number of rounds logarithmic in the
    longest path. Only whether that is so comes to the driver. An empty edge
    table gives an empty result.
    """
    edges = keep(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    for _ in range(rounds):
        if _settled(edges):
            break
        before, edges = edges, keep(_star(_star(edges, True), False).distinct(), "edges")
        drop(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return down.select(F.col("a").alias("id"), F.col("b").alias("component")).union(down.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
