"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b), root being the smallest vertex of its component.

    A large-star step links each vertex's larger neighbours with its smallest one, a small-star step its smaller ones and itself;
    both keep components, and repeated they end in one star for each. Rounds grow with the logarithm of the vertices.
    All state stays in tables; a count and a checksum reach the driver. A vertex's smallest neighbour is a partial
    minimum and comes back by a join, so a vertex with any number of links is never gathered in one group.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        sign = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == seen or not sign[0]:
            break
        seen = sign
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        edges = cut(small.distinct())
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
