"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

EDGES_PER_PART = 100_000


def components(edges: DataFrame) -> DataFrame:
    """`edges`: a, b of one ordered type. Gives node, root (the smallest node of its component) for every node that
    is not a root itself.

    Each round hangs every node's larger neighbours on the smallest node near it, then every node's smaller
    neighbours; the number of edges does not grow, and rounds grow with the logarithm of a component's size. Minima
    are partial aggregates, so a node with many edges is no hot group. Each round is written to shared storage; no round
    is needed once the edges are stars.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def settled(df: DataFrame) -> bool:
        """All nodes hang on one smaller node each, which hangs on none."""
        nodes = df.select(F.col("a").alias("node"), "b", F.lit(0).alias("root")).unionByName(
            df.select(F.col("b").alias("node"), F.lit(None).cast(df.schema["b"].dataType).alias("b"), F.lit(1).alias("root")))
        seen = nodes.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max("root").alias("root"))
        return seen.where("low < high or (root = 1 and low is not null)").count() == 0

    edges = c.materialise(ordered(edges))
    n = edges.count()  # it does not grow
    parts = max(8, n // EDGES_PER_PART)  # few small files where edges are few

    def by_node(df: DataFrame) -> DataFrame:
        """A table of at most two rows per edge, broadcast while that is few."""
        return F.broadcast(df) if 2 * n <= c.BROADCAST_ROWS else df

    while not settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(by_node(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(by_node(least), "a")
        hung = F.explode(F.when(F.col("b") == F.col("m"), F.array(F.struct("a", F.col("m").alias("b")))).otherwise(
            F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        edges = c.materialise(joined.select(hung.alias("_e")).select("_e.a", "_e.b").distinct().coalesce(parts))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
