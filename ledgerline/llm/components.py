"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import durable


def _least(pairs: DataFrame) -> DataFrame:
    """(node, least): the smallest neighbour or the node itself, combined in the map tasks first."""
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).withColumnRenamed("a", "node")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it can reach.

    Each round first hangs every larger neighbour of a node on the smallest one, then every node's
    smaller neighbours on the smallest of them (large star, small star).  The rounds grow
    with the logarithm of the number of nodes, not with the length of a chain, and the number of
    links never grows.  Every half round is a count-combined minimum and an equi-join, whose hot
    side adaptive execution can split; it is written to the shared folder, so a lost executor costs one half round.

    Links with a null end and links from a node to itself are left out.  No links give no rows.
    """
    plain = links.select("a", "b").where(F.col("a") != F.col("b"))
    edges = durable(plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        larger = both.where(F.col("b") > F.col("a"))
        spread = larger.join(_least(both).withColumnRenamed("node", "a"), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = spread.where(F.col("a") != F.col("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("least")), "a")
        hung = small.where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = durable(small.select("a", F.col("least").alias("b")).unionByName(hung).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
