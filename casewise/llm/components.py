"""Connected components with DataFrame operations: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return int(row.n), int(row.h)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it."""
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    tied = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    tied = down.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("k").alias("a"), F.col("m").alias("b"))
    return tied.union(own).where("a != b").distinct()


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): component is its least reachable node.

    A node's neighbours are only ever summed up (minimum, combined before the shuffle) or joined on
    it, where a hub's rows can be split. Each step ends in a table in the shared folder; steps grow
    with the logarithm of a component's width. Nulls and self-links are dropped.
    """
    own = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    now = materialize(own.distinct(), tag)
    state = _state(now)
    while state[0]:
        after = materialize(_small_star(_large_star(now)), tag)
        discard(now)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b"), F.col("b")).distinct()
    )
