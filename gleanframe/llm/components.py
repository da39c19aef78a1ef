"""Connected components by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanframe.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); root is the smallest node.

    Each round hangs every node's larger neighbours on its smallest one, then every node's
    smaller neighbours on the smallest of them; a number of rounds in the order of the squared
    logarithm of the nodes leaves one star per component. Minima are combined before the shuffle
    and joined back, so a node with very many neighbours is never gathered; its join partition is
    one that Spark splits. Each round is cut off by a checkpoint, and the loop ends when a round
    changes nothing (number and checksum of the edges). Null ends and loops are left out.
    """
    now = materialise(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (state := checksum(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every edge now goes from a node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        now = materialise(small)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
