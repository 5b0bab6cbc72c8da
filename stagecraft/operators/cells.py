"""Ordered work inside groups of any size.

A plain ``Window.partitionBy(key).orderBy(t)`` sends a whole key to one task, and one key may hold a third of all rows.
So the keys are counted first.  Keys of ordinary size go through a plain window.  The rows of hot keys are cut into
*cells*, consecutive ranges of (key, whole order) of about equal row counts, found by Spark's range partitioning, and
the window runs per (key, cell).  What crosses a cell border (row counts before the cell, the neighbour on the other
side, the rank of a value that began earlier) comes from one small aggregate row per (key, cell), added to the data as a
border row, so there is no join and NULL keys work like any other key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stagecraft.runtime import store, store_counted

CELL = "_cell"


def width_cells(col: Column, width: int) -> Column:
    """Cells of a fixed width on a numeric code; needs no pass over the data."""
    return F.coalesce(F.floor(col / F.lit(width)), F.lit(-(2**62))).cast("long")


def day_cells(col: Column, days: int = 30) -> Column:
    return width_cells(F.unix_date(col.cast("date")), days)


RANGE = "_range"


def range_cells(df: DataFrame, order: list[Column], rows_per_cell: int = 2_000_000) -> DataFrame:
    """The table with a column ``_range``: consecutive ranges of a whole order, of about equal row counts.

    Spark's range partitioning splits by all order columns in their directions, so rows that agree in the
    leading one, long texts with a shared beginning and descending columns are cut like any other.  The
    dealt-out rows are stored, since later passes must see the same ranges.
    """
    held, n = store_counted(df, "unordered", rows=F.lit(True))
    cells = -(-n["rows"] // rows_per_cell)
    if cells <= 1:
        return held.withColumn(RANGE, F.lit(0).cast("long"))
    return store(held.repartitionByRange(cells, *order).withColumn(RANGE, F.spark_partition_id().cast("long")), "ranges")


def split_hot(df: DataFrame, keys: list[str], rows_per_cell: int = 2_000_000) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys of at most ``rows_per_cell`` rows, and those of the other, hot keys (None if there are none).

    One aggregate counts the keys.  There are at most rows / ``rows_per_cell`` hot ones.
    """
    names = [f"_hot_{i}" for i in range(len(keys))]
    hot, n = store_counted(
        df.groupBy(*[F.col(k).alias(h) for k, h in zip(keys, names)]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_cell),
        "hot-keys", any=F.lit(True))
    if not n["any"]:
        return df, None
    same = [F.col(k).eqNullSafe(F.col(h)) for k, h in zip(keys, names)]
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def neighbour_by_size(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], step: int = 1,
                      rows_per_cell: int = 2_000_000) -> DataFrame:
    """``neighbour`` with cells of equal row counts, for hot keys alone."""
    cold, hot = split_hot(df, keys, rows_per_cell)
    w = Window.partitionBy(*keys).orderBy(*order)
    move = F.lead if step == 1 else F.lag
    out = cold.select("*", *[move(src).over(w).alias(new) for new, src in values.items()])
    if hot is None:
        return out
    dealt = range_cells(hot, [F.col(c) for c in [*keys, *order]], rows_per_cell)
    return out.unionByName(neighbour(dealt, keys, order, F.col(RANGE), values, step).drop(RANGE))


def rank_by_size(df: DataFrame, keys: list[str], order: str, tiebreak: str, rows_per_cell: int = 2_000_000) -> DataFrame:
    """Add ``row_number`` by (order, tiebreak), ``rank`` by order and ``next_value``, the order column of the next row."""
    cold, hot = split_hot(df, keys, rows_per_cell)
    w = Window.partitionBy(*keys)
    total = w.orderBy(order, tiebreak)
    out = cold.select("*", F.row_number().over(total).cast("long").alias("row_number"), F.rank().over(w.orderBy(order)).cast("long").alias("rank"),
                      F.lead(order).over(total).alias("next_value"))
    if hot is None:
        return out
    dealt = range_cells(hot, [F.col(c) for c in [*keys, order, tiebreak]], rows_per_cell)
    numbered = number_rows(dealt.withColumn("_at", F.col(RANGE)), keys, [F.col(order), F.col(tiebreak)], F.col(RANGE))
    moved = neighbour(numbered, keys, [order, tiebreak], F.col(RANGE), {"next_value": order})
    return out.unionByName(_ranked(moved, keys, order).drop(RANGE, "_at").select(out.columns))


def _ranked(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add ``rank`` to rows that are numbered in their whole group; a value may reach over several cells."""
    data = df.withColumn("_rank", F.min("row_number").over(Window.partitionBy(*keys, RANGE, order)))
    value = F.struct(order)
    ends = data.groupBy(*keys, RANGE).agg(F.min(value).alias("_first"), F.max(value).alias("_last"), F.max("_rank").alias("_run"))
    cells = Window.partitionBy(*keys).orderBy(RANGE)
    reaches = F.lag("_last").over(cells) == F.col("_first")
    # The rank of a cell's last value, where that value begins in the cell.
    begun = F.when(~(F.coalesce(reaches, F.lit(False)) & (F.col("_first") == F.col("_last"))), F.col("_run"))
    borders = ends.withColumn("_begun", begun).withColumn("_tie", F.when(reaches, F.last("_begun", ignorenulls=True).over(
        cells.rowsBetween(Window.unboundedPreceding, -1)))).select(*keys, RANGE, F.col("_first").alias("_border"), "_tie")
    both = data.unionByName(borders, allowMissingColumns=True)
    is_border = F.col("_border").isNotNull()
    w = Window.partitionBy(*keys, RANGE).orderBy(F.when(is_border, 0).otherwise(1))
    tie, first = F.first("_tie").over(w), F.first("_border").over(w)
    out = both.withColumn("_first_tie", tie).withColumn("_first_value", first).where(~is_border)
    rank = F.when((F.col("_first_value") == F.struct(order)) & F.col("_first_tie").isNotNull(), F.col("_first_tie")).otherwise(F.col("_rank"))
    return out.withColumn("rank", rank.cast("long")).drop("_rank", "_border", "_tie", "_first_tie", "_first_value")


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    cell: Column,
    row_number: str | None = "row_number",
    rank: str | None = None,
) -> DataFrame:
    """``row_number`` (and ``rank``) per group; ``keys=[]`` numbers the whole table."""
    data = df.withColumn(CELL, cell)
    sizes = data.groupBy(*keys, CELL).agg(F.count(F.lit(1)).alias("_size"))
    earlier = (
        Window.partitionBy(*keys).orderBy(CELL)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    borders = sizes.select(
        *keys, CELL, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    )
    both = data.withColumn("_before", F.lit(None).cast("long")).unionByName(
        borders, allowMissingColumns=True
    )
    is_border = F.col("_before").isNotNull()
    group = Window.partitionBy(*keys, CELL)
    # The border row sorts first and carries the count of all earlier cells.
    local = group.orderBy(F.when(is_border, 0).otherwise(1), *order)
    start = F.first("_before").over(local)
    out = both.withColumn("_start", start)
    if row_number:
        out = out.withColumn(row_number, (F.row_number().over(local) - 1 + F.col("_start")).cast("long"))
    if rank:
        out = out.withColumn(rank, (F.rank().over(local) - 1 + F.col("_start")).cast("long"))
    return out.where(~is_border).drop(CELL, "_before", "_start")


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    cell: Column,
    values: dict[str, str],
    step: int = 1,
) -> DataFrame:
    """Add columns of the next (``step=1``) or previous (``-1``) row of the group.

    ``order`` must be a total ascending order inside the group and ``cell`` must not decrease
    along it.  ``values`` maps new column name -> source column.
    """
    if step not in (1, -1):
        raise ValueError("step is 1 or -1")
    data = df.withColumn(CELL, cell)
    carried = list(dict.fromkeys([*order, *values.values()]))
    edge = F.min if step == 1 else F.max
    # The order is total, so the edge row is the least (greatest) struct.  A single column needs no
    # struct and aggregates by hash.
    lead_values = edge(carried[0]) if len(carried) == 1 else edge(F.struct(*carried))
    edges = data.groupBy(*keys, CELL).agg(lead_values.alias("_row"))
    from_row = [F.col("_row").alias(carried[0])] if len(carried) == 1 else [
        F.col(f"_row.{c}").alias(c) for c in carried
    ]
    cells = Window.partitionBy(*keys).orderBy(CELL)
    # The edge row of a cell joins the cell on the side it is a neighbour of.
    shifted = F.lag(CELL).over(cells) if step == 1 else F.lead(CELL).over(cells)
    borders = (
        edges.withColumn("_to", shifted)
        .where(F.col("_to").isNotNull())
        .select(
            *[k for k in keys if k not in carried],
            *from_row,
            F.col("_to").alias(CELL), F.lit(True).alias("_border"),
        )
    )
    both = data.withColumn("_border", F.lit(False)).unionByName(borders, allowMissingColumns=True)
    w = Window.partitionBy(*keys, CELL).orderBy(*order)
    move = F.lead if step == 1 else F.lag
    out = both.select("*", *[move(src).over(w).alias(new) for new, src in values.items()])
    return out.where(~F.col("_border")).drop(CELL, "_border")
