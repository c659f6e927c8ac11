"""Connected components by alternating star contractions, each round a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, hot: bool) -> DataFrame:
    """(u, v, m): each pair with the smallest node among u and its neighbours.

    hot: a u may have very many neighbours; the smallest nodes are written first, so
    that both sides of the join are plain shuffles, which Spark splits.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(stage(least) if hot else least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the smallest node that it reaches.

    Loops and repeated edges are harmless; no edges give no rows. Each round keeps
    at most one edge a node and neighbour, so tables never grow beyond the input.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, _signature(edges)
    while now != before and now[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, hot=True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large, hot=False).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("a"), F.col("e.m").alias("b")).where("a <> b")
        edges = stage(small.distinct())
        before, now = now, _signature(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
