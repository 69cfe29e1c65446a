"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.llm._common import cut


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """Every neighbour ``v`` of ``u`` that fulfils ``keep``, with the least node around ``u``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return pairs.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is named by its least node.

    ``a`` and ``b`` are of one orderable type and not null. Each round is two shuffles of at
    most as many edges as the round before, cut from its lineage; the number of rounds grows
    with the logarithm of the longest path. Nothing but an edge count and a checksum reaches
    the driver. Hubs are pre-aggregated by ``min`` and their join is left to AQE to split.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, "v > u").distinct()
        # after a large-star step b < a: u's smaller neighbours, with u itself hung onto the least of them
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u").select(
            F.explode(
                F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
            ).alias("e")
        )
        now = cut(hung.select("e.a", "e.b").where("a <> b").distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
