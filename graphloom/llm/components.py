"""Connected components of links between integer ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, dealt, drop


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Large: larger neighbours move to the smallest one; small: the node and its smaller ones do."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    joined = both.join(least.withColumnRenamed("u", "w"), dealt("u") == dealt("w"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for every id that `links` (a, b) has; component is the smallest id reachable.

    Each round is two joins on a node with the smallest neighbour of the node, which is one row and has a shuffle of its
    own, so that the adaptive skew join splits a node of many links. Rounds are written to the shared folder, and grow with the logarithm of the
    longest path. Empty links give no rows; loops and repeated links do not matter.
    """
    edges, before = cut(links.select("a", "b").where("a != b").distinct(), "links"), None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        after = cut(_starred(_starred(edges, True), False), "links")
        drop(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
