"""Pivot, unpivot, funnel, sort and partition stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stagecraft.operators.cells import RANGE, number_rows, range_cells


def pivot_rows(df: DataFrame, keys: list[str], column: str, values: list[str],
               measures: dict[str, Column]) -> DataFrame:
    """Rows to columns.  The values are named, so no pass over the data is needed to find them."""
    out = df.groupBy(*keys).pivot(column, values).agg(*[c.alias(n) for n, c in measures.items()])
    if len(measures) == 1:
        (name,) = measures
        for v in values:
            out = out.withColumnRenamed(v, f"{v}_{name}")
    return out


def unpivot_cols(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def funnel(*inputs: DataFrame) -> DataFrame:
    """Union all by column name; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def sort_expressions(keys: str) -> list[Column]:
    """``A ASC, B DESC NULLS FIRST`` -> sort columns (NULLs first going up, last going down)."""
    out = []
    for item in keys.split(","):
        words = item.split()
        col, rest = F.col(words[0]), " ".join(words[1:]).upper()
        down = "DESC" in rest
        first = "NULLS FIRST" in rest or (not down and "NULLS LAST" not in rest)
        if down:
            out.append(col.desc_nulls_first() if first else col.desc_nulls_last())
        else:
            out.append(col.asc_nulls_first() if first else col.asc_nulls_last())
    return out


def sort_rows(df: DataFrame, keys: str, tiebreak: str | None = None) -> DataFrame:
    """Sort stage.  A unique tiebreak column makes the order total ("stable")."""
    order = sort_expressions(keys)
    return df.orderBy(*order, *([F.col(tiebreak)] if tiebreak else []))


def sort_positions(df: DataFrame, keys: str, tiebreak: str, name: str = "position", rows_per_cell: int = 2_000_000) -> DataFrame:
    """The sort order as a column, without ordering the table inside one task.

    Cells are ranges of the whole order in its own directions, so descending keys count from their end.
    """
    order = [*sort_expressions(keys), F.col(tiebreak)]
    return number_rows(range_cells(df, order, rows_per_cell), [], order, F.col(RANGE), row_number=name).drop(RANGE)


def partition_hash(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)


def partition_range(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def partition_round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def partition_same(df: DataFrame) -> DataFrame:
    return df
