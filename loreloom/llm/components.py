"""Connected components by alternating large-star and small-star steps; every step writes to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b), with component the least id that it is connected with.

    Neighbours meet only in aggregates (min), never in one list, so a node with very many edges is no problem.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).filter("v <> w").distinct())
    while True:
        both = e.unionByName(e.select(F.col("w").alias("v"), F.col("v").alias("w")))
        low = both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
        large = both.join(low, "v").filter("w > v").select(F.col("w").alias("v"), F.col("m").alias("w")).filter("v <> w").distinct()
        least = large.groupBy("v").agg(F.min("w").alias("m"))
        small = large.join(least, "v").select(F.col("w").alias("v"), F.col("m").alias("w")).unionByName(least.select("v", F.col("m").alias("w"))).filter("v <> w")
        nxt = cut(small.select(F.greatest("v", "w").alias("v"), F.least("v", "w").alias("w")).distinct())
        if nxt.count() == e.count() and nxt.exceptAll(e).isEmpty():
            break
        e = nxt
    out = e.groupBy("v").agg(F.min("w").alias("component")).withColumnRenamed("v", "id")
    return out.unionByName(out.select(F.col("component").alias("id"), "component").distinct())
