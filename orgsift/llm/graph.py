"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node next to it or itself."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every end of an edge; the component is its smallest id.

    `edges` has comparable columns a, b.  Null ends and loops are left out; repeated edges count
    once; no edges give no rows.  Alternating star rounds: a node is only ever linked to its least
    neighbour, so a hub is one aggregated row per task, and the number of rounds grows with the
    logarithm of the longest path.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = checkpointed(now), None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = checkpointed(_small_star(_large_star(now)).distinct())
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
