"""Aggregate stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from stagecraft.operators.cells import RANGE, number_rows, range_cells, split_hot

# Aggregate names of the stage language.  FIRST and LAST need an order and COLLECT_LIST gives several rows
# a group, see below.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MAX": F.max, "MIN": F.min,
    "STDDEV": F.stddev, "VARIANCE": F.variance,
}


def aggregate(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Group by the keys (none: whole table).  Partial aggregation runs before the shuffle."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def first_by(value: str, order: list[str]) -> Column:
    """FIRST with an explicit order; a mergeable aggregate, unlike ``first`` over a sorted group."""
    return F.min_by(value, F.struct(*order))


def last_by(value: str, order: list[str]) -> Column:
    return F.max_by(value, F.struct(*order))


def collect_pieces(df: DataFrame, keys: list[str], value: str, rows: int, name: str, rows_per_cell: int = 2_000_000) -> DataFrame:
    """COLLECT_LIST in sorted pieces of at most ``rows`` values: keys, ``piece`` from 0, the list.

    One list per key would put a hot key into one row.  Values are numbered within their key, by a plain window for keys of
    ordinary size and by cells for hot ones; a value that fills half of a hot key is cut like any other, since rows of
    equal values are told apart by a hash of their place.  NULL values are left out, as COLLECT_LIST does.
    """
    held = df.where(F.col(value).isNotNull()).select(*keys, value)
    cold, hot = split_hot(held, keys, rows_per_cell)
    placed = cold.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(value)).cast("long"))
    if hot is not None:
        order = [F.col(value), F.col("_place")]
        dealt = range_cells(hot.withColumn("_place", F.xxhash64(F.monotonically_increasing_id())), [*map(F.col, keys), *order], rows_per_cell)
        placed = placed.unionByName(number_rows(dealt, keys, order, F.col(RANGE), "_nth").drop(RANGE, "_place"))
    return placed.withColumn("piece", F.floor((F.col("_nth") - 1) / F.lit(rows)).cast("long")).groupBy(*keys, "piece").agg(
        F.sort_array(F.collect_list(value)).alias(name))
