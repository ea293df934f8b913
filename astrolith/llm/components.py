"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for each identifier of an edge, root being the smallest of its component.

    Alternates large-star and small-star steps, which halve paths: the number of rounds grows with the logarithm of the
    longest path. Null ends and loops are left out; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL").where("u <> v").distinct()
    e = cut(e)
    seen = None
    while True:
        # large star: each neighbour that is larger than the node is tied to the least of the neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: all neighbours that are smaller, and the node, are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    own = e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(own)
