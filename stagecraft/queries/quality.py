"""Data-check and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagecraft.operators import quality
from stagecraft.plans import customer_sales
from stagecraft.queries.changes import IMAGES, VALUES, after, before
from stagecraft.queries.registry import Tables, query
from stagecraft.queries.stages import (
    JOIN_SQL, SETTLED, SALE_OPTIONS, SALES_SQL, active_customers, customers, order_rows, sales,
)

c = F.col


@query("dq_row_counts", """
    WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    f AS (SELECT * FROM j WHERE l_extendedprice > 50000 AND l_returnflag <> 'R')
    SELECT 'lines' AS stage, 'rows' AS metric, count(*) AS n, 1 AS ok FROM lineitem
    UNION ALL SELECT 'lines', 'returned', count(*) FILTER (l_returnflag = 'R'), 1 FROM lineitem
    UNION ALL SELECT 'orders', 'rows', count(*), 1 FROM orders UNION ALL SELECT 'join', 'rows', count(*), 1 FROM j
    UNION ALL SELECT 'filter', 'rows', count(*), 1 FROM f UNION ALL SELECT 'groups', 'rows', count(DISTINCT l_returnflag), 1 FROM f""")
def dq_row_counts(t: Tables):
    """Counts of five stages, taken by the flow itself as it runs once."""
    counts = quality.StageCounts()
    lines = counts.watch(t.lineitem.select("l_orderkey", "l_extendedprice", "l_returnflag"), "lines", returned=c("l_returnflag") == "R")
    orders = counts.watch(t.orders.select(c("o_orderkey").alias("l_orderkey")), "orders")
    joined = counts.watch(lines.join(orders, "l_orderkey"), "join")
    kept = counts.watch(joined.where("l_extendedprice > 50000 AND l_returnflag <> 'R'"), "filter")
    groups = counts.watch(kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")), "groups")
    groups.write.format("noop").mode("overwrite").save()
    return counts.report(t.spark)


@query("dq_stage_outputs", """
    SELECT 'customers' AS stage, count(*) AS rows, 1 AS ok FROM customer
    UNION ALL SELECT 'rich', count(*), CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM customer WHERE c_acctbal > 1000000""")
def dq_stage_outputs(t: Tables):
    counts = quality.StageCounts()
    customers = counts.watch(t.customer.select("c_acctbal"), "customers")
    counts.watch(customers.where("c_acctbal > 1000000"), "rich").write.format("noop").mode("overwrite").save()
    return counts.report(t.spark).select("stage", c("n").alias("rows"), "ok")


@query("dq_rule_report", SALES_SQL + """
    SELECT 'net_positive' AS rule, count(*) FILTER (net > 0) AS passed, count(*) FILTER (net <= 0) AS failed, count(*) FILTER (net IS NULL) AS is_null FROM derived
    UNION ALL SELECT 'tier_boundary', count(*) FILTER ((tier = 'GOLD') = (net > 10000)), count(*) FILTER ((tier = 'GOLD') <> (net > 10000)), 0 FROM derived
    UNION ALL SELECT 'bulk', count(*) FILTER (nullif(l_quantity, 50) >= 40), count(*) FILTER (nullif(l_quantity, 50) < 40), count(*) FILTER (l_quantity = 50) FROM derived""")
def dq_rule_report(t: Tables):
    rows = customer_sales.transform(customers(t), sales(t), **SALE_OPTIONS)
    return quality.rule_report(rows, {
        "net_positive": c("NET_AMOUNT") > 0,
        "tier_boundary": (c("CUSTOMER_TIER") == "GOLD") == (c("NET_AMOUNT") > 10000),
        "bulk": F.nullif("QUANTITY", F.lit(50.0)) >= 40,
    })


@query("dq_join_report", JOIN_SQL.split("SELECT custkey, orderkey")[0].format(settled=SETTLED) + """
    SELECT count(*) FILTER (custkey IN (SELECT custkey FROM r)) AS matched_left, count(*) FILTER (custkey NOT IN (SELECT custkey FROM r)) AS unmatched_left,
           (SELECT count(*) FROM r WHERE custkey NOT IN (SELECT custkey FROM l)) AS unmatched_right,
           (SELECT count(*) FROM l JOIN r USING (custkey)) AS joined_rows, 1::BIGINT AS max_fan_out FROM l""")
def dq_join_report(t: Tables):
    return quality.join_report(order_rows(t, settled=True), active_customers(t), ["custkey"])


@query("dq_reconcile_totals", """
    SELECT 'rows' AS measure, count(*)::DOUBLE AS source, (count(*) FILTER (o_orderstatus <> 'P'))::DOUBLE AS target,
           (count(*) FILTER (o_orderstatus <> 'P') - count(*))::DOUBLE AS difference FROM orders
    UNION ALL SELECT 'price', CAST(sum(p) AS DOUBLE), CAST(sum(p) FILTER (o_orderstatus <> 'P') AS DOUBLE),
           CAST(sum(p) FILTER (o_orderstatus <> 'P') - sum(p) AS DOUBLE) FROM (SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS p, * FROM orders)""")
def dq_reconcile_totals(t: Tables):
    price = {"price": F.sum(c("o_totalprice").cast("decimal(18,2)"))}
    out = quality.reconcile_totals(t.orders, t.orders.where("o_orderstatus <> 'P'"), price)
    return out.select("measure", *[c(x).cast("double").alias(x) for x in ("source", "target", "difference")])


@query("dq_reconcile_rows", IMAGES + """
    SELECT coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN b.id IS NULL THEN 'extra' ELSE 'changed' END AS state,
           CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN concat_ws(',', CASE WHEN a.name IS DISTINCT FROM b.name THEN 'name' END,
             CASE WHEN a.nation IS DISTINCT FROM b.nation THEN 'nation' END, CASE WHEN a.balance IS DISTINCT FROM b.balance THEN 'balance' END) ELSE '' END AS changed
    FROM before b FULL JOIN after a ON a.id = b.id
    WHERE a.id IS NULL OR b.id IS NULL OR (a.name, a.nation, a.balance) IS DISTINCT FROM (b.name, b.nation, b.balance)""")
def dq_reconcile_rows(t: Tables):
    return quality.reconcile_rows(before(t), after(t), ["id"], VALUES)


@query("dq_required_columns", """
    SELECT 'c_custkey' AS "column", count(*) FILTER (c_custkey IS NULL) AS nulls, 1 AS ok FROM customer
    UNION ALL SELECT 'nation', count(*) FILTER (nullif(c_nationkey, 7) IS NULL), 0 FROM customer""")
def dq_required_columns(t: Tables):
    rows = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(7)).alias("nation"))
    return quality.required_columns(rows, ["c_custkey", "nation"])
