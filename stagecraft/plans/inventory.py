"""Inventory reconciliation: lookup, left join with exceptions, type 2 dimension load."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from stagecraft.functions import maths, nulls
from stagecraft.operators.changes import OPEN_END, scd2_merge
from stagecraft.operators.joins import join_with_reject, lookup
from stagecraft.operators.project import derive
from stagecraft.sources.sinks import quarantine

KEY = ["ITEM_CODE", "WAREHOUSE_ID"]
TRACKED = ["RECORD_HASH"]


class Outputs(NamedTuple):
    main: DataFrame
    exceptions: DataFrame


def derivations(run_date: str) -> list[tuple[str, Column]]:
    available, level = F.col("AVAILABLE_QTY"), F.col("REORDER_LEVEL")
    return [
        ("AVAILABLE_QTY", F.col("ON_HAND_QTY") - F.col("RESERVED_QTY")),
        ("INVENTORY_VALUE", (F.col("ON_HAND_QTY") * F.col("UNIT_COST")).cast("decimal(24,4)")),
        ("STOCK_STATUS", nulls.conditional(
            [(available == 0, "OUT_OF_STOCK"), (available < level, "LOW_STOCK")], "IN_STOCK")),
        ("REORDER_REQUIRED", nulls.conditional([(available < level, 1)], 0)),
        ("DAYS_UNTIL_REORDER", nulls.conditional(
            [(F.col("REORDER_REQUIRED") == 1, F.col("LEAD_TIME_DAYS"))], -1)),
        ("RECORD_HASH", maths.checksum("ITEM_CODE", "WAREHOUSE_ID", "ON_HAND_QTY", "UNIT_COST")),
        ("SCD_EFF_START_DATE", F.lit(run_date).cast("date")),
        ("SCD_EFF_END_DATE", F.lit(OPEN_END).cast("date")),
        ("IS_CURRENT_FLAG", F.lit(1)),
    ]


def reconcile(stock: DataFrame, items: DataFrame, suppliers: DataFrame, run_date: str) -> Outputs:
    """Stock rows with their item and supplier data; stock without an item is an exception."""
    master = lookup(items, suppliers, ["SUPPLIER_ID"], "Continue").main
    joined = join_with_reject(stock, master, ["ITEM_CODE"])
    return Outputs(derive(joined.main, derivations(run_date)), quarantine(joined.reject, run_date))


def load_dimension(dim: DataFrame, rows: DataFrame, run_date: str) -> DataFrame:
    """Merge the reconciled snapshot into the type 2 dimension (see ``scd2_merge``).

    Record hashes, most of a row, are shuffled as bytes.
    """
    def packed(df: DataFrame) -> DataFrame:
        return df.withColumns({h: maths.pack_digest(h) for h in TRACKED})

    loaded = scd2_merge(packed(dim), packed(rows.select(*KEY, *TRACKED)), KEY, TRACKED, run_date)
    return loaded.withColumns({h: maths.unpack_digest(h) for h in TRACKED})
