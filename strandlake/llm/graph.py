"""Connected components as DataFrame operations.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): every step is a grouped minimum, which combines before the shuffle, and a
join on a node, whose hot keys AQE splits. No node's neighbours meet in one task's memory,
and nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.scratch import Scratch


def connected_components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Edges may repeat, run either way or be loops; edges with a null end are ignored. Nodes that
    no edge between two different nodes touches are absent: they are components of their own.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, seen = scratch.table(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
        if now == seen or not now[0]:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        seen = now
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.table(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
