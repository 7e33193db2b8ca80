"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm.common import kept


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    near = _both_ways(edges)
    best = _least(near).select("a", F.least("a", "m").alias("m"))
    linked = near.where("b > a").join(best, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; ``a > b`` in ``edges``."""
    best = _least(edges)
    others = edges.join(best, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(best.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node with a link; a component is its smallest node.

    Stars are formed in turn around larger and smaller neighbours until nothing changes, which
    takes about as many rounds as the logarithm of the longest chain. Each round is written to the
    shared folder, so its plan stays short and lost executors cost one round at most. Self-links,
    repeated links and nulls are ignored.
    """
    pairs = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    tidy = pairs.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    now = kept(tidy.distinct(), "links")
    state = None
    while True:
        count = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(count) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = tuple(count)
        now = kept(_small_star(_large_star(now)), "links")
