"""The two sample jobs end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stagecraft.operators.changes import OPEN_END
from stagecraft.operators.shape import sort_rows
from stagecraft.plans import customer_sales, inventory
from stagecraft.queries.registry import Tables, query
from stagecraft.queries.stages import SALE_OPTIONS, SALES_SQL, customers, sales

c = F.col
RUN_DATE = "2002-01-01"
FIRST_DATE = "1999-01-01"


@query("job_customer_sales", SALES_SQL + """
    SELECT r_name AS "REGION", c_mktsegment AS "SEGMENT", CAST(year(d) AS INTEGER) AS "SALE_YEAR",
           CAST(month(d) AS INTEGER) AS "SALE_MONTH", CAST(sum(net) AS DOUBLE) AS "TOTAL_REVENUE",
           count(*) AS "TOTAL_ORDERS", CAST(sum(net) AS DOUBLE) / count(net) AS "AVG_ORDER_VALUE",
           CAST(max(net) AS DOUBLE) AS "MAX_ORDER_VALUE"
    FROM derived GROUP BY ALL""")
def job_customer_sales(t: Tables):
    return customer_sales.run(customers(t), sales(t), **SALE_OPTIONS)


STOCK_SQL = """
    WITH stock AS (SELECT CAST(l_partkey AS VARCHAR) AS item, CAST(l_suppkey AS VARCHAR) AS warehouse, CAST(sum(l_quantity) AS BIGINT) AS on_hand,
                          count(*) FILTER (l_returnflag = 'R') * 20 AS reserved, CAST(max(l_tax) AS DECIMAL(12,4)) AS cost FROM lineitem {where} GROUP BY ALL),
    items AS (SELECT CAST(p_partkey AS VARCHAR) AS item, p_type AS category, CAST(p_size AS BIGINT) AS supplier, p_size * 2 AS level, p_size % 14 AS lead_time
              FROM part WHERE p_size > 10),
    joined AS (SELECT s.*, i.level, i.lead_time, u.s_name, on_hand - reserved AS available,
                 sha256(concat_ws('|', s.item, warehouse, CAST(on_hand AS VARCHAR), CAST(cost AS VARCHAR))) AS h
               FROM stock s JOIN items i ON i.item = s.item LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 1000) u ON u.s_suppkey = i.supplier)"""


def stock(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    lines = t.lineitem if lines is None else lines
    return lines.groupBy(
        c("l_partkey").cast("string").alias("ITEM_CODE"), c("l_suppkey").cast("string").alias("WAREHOUSE_ID")
    ).agg(
        F.sum("l_quantity").cast("bigint").alias("ON_HAND_QTY"),
        (F.count(F.when(c("l_returnflag") == "R", 1)) * 20).alias("RESERVED_QTY"),
        F.max("l_tax").cast("decimal(12,4)").alias("UNIT_COST"),
    )


def reconciled(t: Tables, lines: DataFrame | None = None, run_date: str = RUN_DATE) -> inventory.Outputs:
    items = t.part.where("p_size > 10").select(
        c("p_partkey").cast("string").alias("ITEM_CODE"), c("p_type").alias("CATEGORY"),
        c("p_size").cast("bigint").alias("SUPPLIER_ID"), (c("p_size") * 2).alias("REORDER_LEVEL"),
        (c("p_size") % 14).alias("LEAD_TIME_DAYS"))
    suppliers = t.supplier.where("s_acctbal > 1000").select(c("s_suppkey").alias("SUPPLIER_ID"), c("s_name").alias("SUPPLIER_NAME"))
    return inventory.reconcile(stock(t, lines), items, suppliers, run_date)


@query("job_inventory_reconciliation", STOCK_SQL.format(where="") + """
    SELECT item AS "ITEM_CODE", warehouse AS "WAREHOUSE_ID", s_name AS "SUPPLIER_NAME", available AS "AVAILABLE_QTY",
           CAST(on_hand * cost AS DOUBLE) AS "INVENTORY_VALUE",
           CASE WHEN available = 0 THEN 'OUT_OF_STOCK' WHEN available < level THEN 'LOW_STOCK' ELSE 'IN_STOCK' END AS "STOCK_STATUS",
           CASE WHEN available < level THEN 1 ELSE 0 END AS "REORDER_REQUIRED",
           CASE WHEN available < level THEN lead_time ELSE -1 END AS "DAYS_UNTIL_REORDER", h AS "RECORD_HASH",
           '2002-01-01' AS "SCD_EFF_START_DATE", '9999-12-31' AS "SCD_EFF_END_DATE", 1 AS "IS_CURRENT_FLAG" FROM joined""")
def job_inventory_reconciliation(t: Tables):
    rows = reconciled(t).main.select(
        "ITEM_CODE", "WAREHOUSE_ID", "SUPPLIER_NAME", "AVAILABLE_QTY", c("INVENTORY_VALUE").cast("double").alias("INVENTORY_VALUE"),
        "STOCK_STATUS", "REORDER_REQUIRED", "DAYS_UNTIL_REORDER", "RECORD_HASH",
        c("SCD_EFF_START_DATE").cast("string").alias("SCD_EFF_START_DATE"),
        c("SCD_EFF_END_DATE").cast("string").alias("SCD_EFF_END_DATE"), "IS_CURRENT_FLAG")
    return sort_rows(rows, "ITEM_CODE ASC, WAREHOUSE_ID ASC")


@query("job_inventory_exceptions", STOCK_SQL.format(where="") + """
    SELECT item AS "ITEM_CODE", warehouse AS "WAREHOUSE_ID", on_hand AS "ON_HAND_QTY", 'No match on ITEM_CODE' AS _reject_reason, '2002-01-01' AS reject_day
    FROM stock WHERE item NOT IN (SELECT item FROM items)""")
def job_inventory_exceptions(t: Tables):
    return reconciled(t).exceptions.select("ITEM_CODE", "WAREHOUSE_ID", "ON_HAND_QTY", "_reject_reason",
                                           c("_reject_date").cast("string").alias("reject_day"))


def _prefixed(sql: str, mark: str) -> str:
    """The stock CTEs under other names, for a second snapshot."""
    for name in ("stock", "items", "joined"):
        sql = sql.replace(f"{name} AS (", f"{name}{mark} AS (").replace(f"FROM {name} ", f"FROM {name}{mark} ").replace(f"JOIN {name} ", f"JOIN {name}{mark} ")
    return sql


@query("job_inventory_dimension", STOCK_SQL.format(where="WHERE l_shipdate < TIMESTAMP '1999-01-01'") + ","
       + _prefixed(STOCK_SQL.format(where=""), "2").split("WITH", 1)[1] + f"""
    SELECT item AS "ITEM_CODE", warehouse AS "WAREHOUSE_ID", a.h AS "RECORD_HASH", '{FIRST_DATE}' AS since,
           CASE WHEN a.h <> b.h THEN '{RUN_DATE}' ELSE '{OPEN_END}' END AS until, CASE WHEN a.h <> b.h THEN 0 ELSE 1 END AS current
    FROM joined a LEFT JOIN joined2 b USING (item, warehouse)
    UNION ALL SELECT b.item, b.warehouse, b.h, '{RUN_DATE}', '{OPEN_END}', 1
    FROM joined2 b LEFT JOIN joined a ON a.item = b.item AND a.warehouse = b.warehouse WHERE a.h IS NULL OR a.h <> b.h""")
def job_inventory_dimension(t: Tables):
    """Two snapshots loaded into the type 2 dimension, one after the other."""
    early = reconciled(t, t.lineitem.where("l_shipdate < TIMESTAMP_NTZ '1999-01-01'"), FIRST_DATE).main
    empty = t.spark.createDataFrame([], (
        "ITEM_CODE string, WAREHOUSE_ID string, RECORD_HASH string, EFF_START_DATE date, EFF_END_DATE date, IS_CURRENT_FLAG int"))
    first = inventory.load_dimension(empty, early, FIRST_DATE)
    second = inventory.load_dimension(first, reconciled(t).main, RUN_DATE)
    return second.select("ITEM_CODE", "WAREHOUSE_ID", "RECORD_HASH", c("EFF_START_DATE").cast("string").alias("since"),
                         c("EFF_END_DATE").cast("string").alias("until"), c("IS_CURRENT_FLAG").alias("current"))
