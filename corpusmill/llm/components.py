"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import ensure_checkpoint_dir


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour (or itself)."""
    pairs = _both_ways(edges)
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (pairs.filter("v > u").join(least, "u")
            .select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct())


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return (moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
            .filter("a <> b").distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge table (a, b); component: its least node.

    Edges with a null end or equal ends are left out; an empty table gives an empty
    result. Minima are aggregated map-side and joined back, so no task holds the
    neighbours of a node. Every round is checkpointed in the shared folder, which cuts
    the lineage and survives lost executors. Ends when a round changes nothing.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = (edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
           .filter("a is not null and b is not null and a <> b").distinct().checkpoint())
    state = None
    for _ in range(max_rounds):
        now = small_star(large_star(now)).checkpoint()
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
