"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is one aggregation and one join over the edges; the edges are written to the shared checkpoint folder after
each round, and only their number and a checksum come to the driver. The number of rounds grows with the logarithm of the nodes.
The joins have a key of their own beside the node: else they would reuse the aggregation's partitions, and those of a node
with very many edges could not be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.llm.common import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _split_join(edges: DataFrame, least: DataFrame) -> DataFrame:
    own = F.xxhash64("u").alias("__u")
    return edges.select("*", own).join(least.select("*", own), ["u", "__u"]).drop("__u")


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _split_join(near.where("v > u"), least).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    other = _split_join(down, least).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return other.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b), except those that are their component's smallest."""
    state = lambda df: df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = state(edges)
    while now[0]:
        edges = cut(_small_star(_large_star(edges)))
        was, now = now, state(edges)
        if was == now:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
