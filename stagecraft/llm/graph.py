"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stagecraft.llm.util import drop_stored
from stagecraft.runtime import store


def connected_components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, root): each node of an undirected link table and the least node it can reach.

    In a large-star round every node passes its least neighbour on to its greater neighbours, in a
    small-star round to the others; the rounds end when the links no longer change, and then each node
    is linked to its root alone.  A node with very many links is a join key that AQE may split, never one
    group in a task.  Each round is stored and the round before it deleted.  NULL ends and loops are left out.
    """
    spark = links.sparkSession
    ends = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    now = store(ends.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct()
                if {left, right} == {"u", "v"} else ends.where("u <> v").distinct(), "links")
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Every link now points from the greater to the lesser node.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        following = store(small, "links")
        drop_stored(spark, now)
        now = following
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
