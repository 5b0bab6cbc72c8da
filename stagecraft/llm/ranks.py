"""Global ranks and running sums over tables of any size, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stagecraft.runtime import store


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Add ``rank`` (from 0) in a total order and, for each name, the sum over all rows before.

    Rows are dealt out by ranges of the order and stored; one row per range, of which there are as many
    as shuffle partitions, carries what the ranges before it hold.
    """
    dealt = store(df.withColumns({f"add_{k}": v for k, v in sums.items()})
                  .repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("range").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"add_{k}").alias(f"all_{k}") for k in sums])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("from_n"),
                           *[F.coalesce(F.sum(f"all_{k}").over(earlier), F.lit(0)).alias(f"from_{k}") for k in sums])
    local = dealt.withColumn("rank", F.row_number().over(inside) - 1).withColumns(
        {k: F.coalesce(F.sum(f"add_{k}").over(before), F.lit(0)) for k in sums})
    joined = local.join(starts, "range")
    return joined.withColumns({"rank": F.col("rank") + F.col("from_n"), **{k: F.col(k) + F.col(f"from_{k}") for k in sums}}).drop(
        "range", "from_n", *[f"add_{k}" for k in sums], *[f"from_{k}" for k in sums])
