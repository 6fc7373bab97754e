"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innings.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` (ids) to ``node, component``, the smallest id that a node reaches.

    Alternating star contractions: every node hangs its larger neighbours, then
    its smaller ones, under the least node it knows. The rounds grow with the
    logarithm of the longest path. A round takes minima with map-side parts and
    one join back, never a list of neighbours; it ends in a written table, so
    a lost executor costs a re-read.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "component-edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "u", "m")
        edges = stored(small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m")))
                                    .alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
                       .where("u <> v").distinct(), "component-edges")
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
