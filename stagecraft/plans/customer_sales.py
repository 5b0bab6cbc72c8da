"""Customer sales summary: two sources, join, six derivations, filter, aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagecraft.functions import dates, nulls, strings
from stagecraft.operators.aggregate import aggregate
from stagecraft.operators.joins import join_stage
from stagecraft.operators.project import derive, filter_rows

MONEY = "decimal(18,4)"

# Tier bounds of the job.
GOLD, SILVER = 10_000, 5_000


def derivations(discount_divisor: int = 100, bulk_quantity: int = 100) -> list[tuple[str, Column]]:
    """CUSTOMER_TIER reads NET_AMOUNT, so the order matters."""
    net = F.col("NET_AMOUNT")
    share = F.col("DISCOUNT_PCT").cast("decimal(9,4)") / F.lit(discount_divisor) \
        if discount_divisor != 1 else F.col("DISCOUNT_PCT").cast("decimal(9,4)")
    return [
        ("NET_AMOUNT", (F.col("AMOUNT").cast("decimal(18,2)") * (F.lit(1) - share)).cast(MONEY)),
        ("CUSTOMER_TIER", nulls.conditional([(net > GOLD, "GOLD"), (net > SILVER, "SILVER")], "BRONZE")),
        ("SALE_YEAR", dates.year("SALE_DATE")),
        ("SALE_MONTH", dates.month("SALE_DATE")),
        ("CUST_NAME_CLEAN", strings.upcase(strings.trim("CUST_NAME"))),
        ("IS_BULK_ORDER", nulls.conditional([(F.col("QUANTITY") >= bulk_quantity, 1)], 0)),
    ]


def transform(customers: DataFrame, sales: DataFrame, **options) -> DataFrame:
    """Joined, derived and filtered rows."""
    joined = join_stage(customers, sales, ["CUST_ID"], "Inner")
    derived = derive(joined, derivations(**options))
    valid = (F.col("NET_AMOUNT") > 0) & F.col("CUST_ID").isNotNull() & F.col("SALE_DATE").isNotNull()
    return filter_rows(derived, valid).main


def summarize(rows: DataFrame) -> DataFrame:
    net = F.col("NET_AMOUNT")
    total = F.sum(net.cast("decimal(28,4)"))
    return aggregate(rows, ["REGION", "SEGMENT", "SALE_YEAR", "SALE_MONTH"], {
        "TOTAL_REVENUE": total.cast("double"),
        "TOTAL_ORDERS": F.count("SALE_ID"),
        "AVG_ORDER_VALUE": total.cast("double") / F.count("NET_AMOUNT"),
        "MAX_ORDER_VALUE": F.max(net).cast("double"),
    })


def run(customers: DataFrame, sales: DataFrame, **options) -> DataFrame:
    return summarize(transform(customers, sales, **options))
