"""Connected components of a large edge list by alternating star contraction, with each round stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_dealt, release, stored


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every larger neighbour of a node to the least node among the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    up = both.filter("v > u")
    return _distinct(join_dealt(up, least, ["u"], F.col("v"), total).select(F.col("v").alias("u"), F.col("_m").alias("v")))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("_m"))
    over = join_dealt(down, least, ["u"], F.col("v"), total).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return _distinct(over.union(least.select("u", F.col("_m").alias("v"))))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes of edges (u, v), both long; root is the least node of the component.

    Every round is a shuffle on nodes with partial aggregates, where the edges of a hub are dealt to several tasks, and a
    stored table that replaces the one before; only two numbers reach the driver. Self-links are ignored; no edges give
    no rows. Edges hold no nulls.
    """
    state = stored(_distinct(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))), "edges")
    total, before = state.count(), None
    for _ in range(most_rounds):
        middle = stored(_large_star(state, total), "stars")
        after = stored(_small_star(middle, total), "stars")
        release(state)
        release(middle)
        state = after
        row = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (now := tuple(row)) == before:
            break
        total, before = now[0], now
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select("v", "v").distinct())
