"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, save


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the smallest vertex of u's component, for each u of edges (a, b) that isn't itself the smallest.

    Each round joins neighbours to the smallest neighbour; no vertex's
    neighbours are ever gathered in one place, and Spark splits the partitions
    of vertices with many. Rounds grow with the logarithm of the vertices.
    """
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = save(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(e)
        e, (old, mark) = new, (mark, _mark(new))
        if mark == old:
            break
    return e


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
