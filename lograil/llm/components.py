"""Connected components of a stored list of links, as alternating star contractions.

Every round is a few aggregations and joins over the links; nothing but one count
and one checksum a round reaches the driver.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.session import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of `links` (a, b); component is its smallest node.

    Direction, repetition and loops of links do not matter; null ends are ignored. A node that
    occurs in no link but a loop, or in none, has no row.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = durable(links.where(F.col("a") != F.col("b")).select(low.alias("a"), high.alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
                edges.select("a", "a").distinct())
        before = state
        edges = durable(_small_star(_large_star(edges)))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    hung = edges.join(least, "b")
    return (hung.select(F.col("m").alias("a"), "b").union(hung.where(F.col("a") != F.col("m")).select("m", "a"))
            .distinct())
