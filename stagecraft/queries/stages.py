"""Projection, filter, routing, join, lookup and aggregate stages over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagecraft.functions import maths, nulls, strings
from stagecraft.operators import by_properties, aggregate as agg, joins, project
from stagecraft.plans import customer_sales
from stagecraft.queries.registry import Tables, query

c = F.col


def money(name: str) -> Column:
    return c(name).cast("decimal(18,2)")


# --- transformer -----------------------------------------------------------------------------

def customers(t: Tables) -> DataFrame:
    """The CUSTOMERS source: customer with its region's name."""
    geo = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select("n_nationkey", "r_name")
    return t.customer.join(geo, c("c_nationkey") == c("n_nationkey")).select(
        c("c_custkey").alias("CUST_ID"), c("c_name").alias("CUST_NAME"), c("r_name").alias("REGION"),
        c("c_mktsegment").alias("SEGMENT"),
    )


def sales(t: Tables) -> DataFrame:
    """The SALES_FACT source: order lines with their order's customer and date."""
    return t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select(
        c("l_orderkey").alias("SALE_ID"), c("o_custkey").alias("CUST_ID"),
        c("l_linenumber").alias("LINE"), c("o_orderdate").cast("date").alias("SALE_DATE"),
        c("l_extendedprice").alias("AMOUNT"), c("l_quantity").alias("QUANTITY"),
        c("l_discount").alias("DISCOUNT_PCT"),
    )


SALES_SQL = """
    WITH sales AS (
      SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, CAST(o_orderdate AS DATE) AS d,
             CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(9,4))) AS DECIMAL(18,4)) AS net
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    derived AS (
      SELECT r_name, c_mktsegment, upper(trim(c_name)) AS clean, s.*,
             CASE WHEN net > 10000 THEN 'GOLD' WHEN net > 5000 THEN 'SILVER' ELSE 'BRONZE' END AS tier,
             CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END AS bulk
      FROM sales s JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey
      WHERE net > 0 AND o_custkey IS NOT NULL AND d IS NOT NULL)
"""
SALE_OPTIONS = {"discount_divisor": 1, "bulk_quantity": 40}


@query("transformer_derivations", SALES_SQL + """
    SELECT tier, CAST(year(d) AS INTEGER) AS sale_year, bulk, count(*) AS n, CAST(sum(net) AS DOUBLE) AS net
    FROM derived GROUP BY ALL""")
def transformer_derivations(t: Tables):
    rows = customer_sales.transform(customers(t), sales(t), **SALE_OPTIONS)
    return rows.groupBy(
        c("CUSTOMER_TIER").alias("tier"), c("SALE_YEAR").alias("sale_year"), c("IS_BULK_ORDER").alias("bulk")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(c("NET_AMOUNT").cast("decimal(28,4)")).cast("double").alias("net"))


@query("transformer_rename_output", "SELECT c_custkey, upper(trim(c_name)) AS cust_name_clean FROM customer")
def transformer_rename_output(t: Tables):
    return t.customer.select("c_custkey", strings.upcase(strings.trim("c_name")).alias("cust_name_clean"))


@query("transformer_conditional", """
    SELECT p_partkey, CASE WHEN p_size = 1 THEN 'MIN' WHEN p_size < 15 THEN 'LOW' WHEN p_size < 35 THEN 'MID'
           ELSE 'HIGH' END AS band FROM part""")
def transformer_conditional(t: Tables):
    size = c("p_size")
    return t.part.select("p_partkey", nulls.conditional(
        [(size == 1, "MIN"), (size < 15, "LOW"), (size < 35, "MID")], "HIGH").alias("band"))


@query("transformer_constant", "SELECT s_suppkey, 1 AS is_current, 'ERP' AS origin FROM supplier")
def transformer_constant(t: Tables):
    return project.derive(t.supplier.select("s_suppkey"), [("is_current", F.lit(1)), ("origin", F.lit("ERP"))])


@query("stage_filter", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
    WHERE l_extendedprice > 50000 AND l_returnflag IS NOT NULL AND l_shipdate >= TIMESTAMP '1998-01-01'""")
def stage_filter(t: Tables):
    return project.filter_rows(
        t.lineitem,
        F.expr("l_extendedprice > 50000 AND l_returnflag IS NOT NULL AND l_shipdate >= TIMESTAMP_NTZ '1998-01-01'"),
    ).main.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("stage_filter_reject", """
    SELECT c_custkey, c_acctbal, CASE WHEN coalesce(nullif(c_nationkey, 3) < 15 AND c_acctbal > 0, false)
           THEN 'main' ELSE 'reject' END AS branch FROM customer""")
def stage_filter_reject(t: Tables):
    out = project.filter_rows(t.customer, (F.nullif("c_nationkey", F.lit(3)) < 15) & (c("c_acctbal") > 0))
    tag = lambda df, b: df.select("c_custkey", "c_acctbal", F.lit(b).alias("branch"))
    return tag(out.main, "main").unionByName(tag(out.reject, "reject"))


@query("stage_route", """
    SELECT CASE WHEN l_returnflag = 'R' THEN 'returns' WHEN l_quantity >= 40 THEN 'bulk'
                WHEN l_discount > 0.05 THEN 'discounted' ELSE 'otherwise' END AS route,
           count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
    FROM lineitem GROUP BY ALL""")
def stage_route(t: Tables):
    branches = project.route(t.lineitem.select("l_returnflag", "l_quantity", "l_discount"), {
        "returns": c("l_returnflag") == "R", "bulk": c("l_quantity") >= 40, "discounted": c("l_discount") > 0.05,
    })
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), F.sum(money("l_quantity")).cast("double").alias("quantity"))
        .select(F.lit(name).alias("route"), "n", "quantity")
        for name, df in branches.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("stage_copy", """
    SELECT 'full' AS output, o_orderkey, o_orderstatus, o_totalprice FROM orders
    UNION ALL SELECT 'slim', o_orderkey, o_orderstatus, NULL FROM orders""")
def stage_copy(t: Tables):
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = project.copy_to(orders, {"full": None, "slim": ["o_orderkey", "o_orderstatus"]})
    return out["full"].withColumn("output", F.lit("full")).unionByName(
        out["slim"].withColumn("output", F.lit("slim")), allowMissingColumns=True
    )


@query("stage_peek", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def stage_peek(t: Tables):
    rows, _ = project.peek(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), "suppliers_peek",
                           {"no_balance": F.count(F.when(c("s_acctbal") <= 0, 1))})
    return rows


@query("stage_null_safe_arith", """
    SELECT c_custkey, coalesce(nullif(c_nationkey, 3), 0) * 10 + coalesce(nullif(c_nationkey, 5), 0) AS points FROM customer""")
def stage_null_safe_arith(t: Tables):
    a, b = F.nullif("c_nationkey", F.lit(3)), F.nullif("c_nationkey", F.lit(5))
    return t.customer.select("c_custkey", (project.null_safe(a) * 10 + project.null_safe(b)).alias("points"))


@query("stage_typed_cast", """
    WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS cust,
                      CASE WHEN o_orderpriority LIKE '5%' THEN 'none' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
               FROM orders)
    SELECT o_orderkey, TRY_CAST(cust AS BIGINT) AS cust, strftime(TRY_CAST(day AS DATE), '%Y-%m-%d') AS day, NULL AS reason
    FROM x WHERE TRY_CAST(cust AS BIGINT) IS NOT NULL AND TRY_CAST(day AS DATE) IS NOT NULL
    UNION ALL
    SELECT o_orderkey, NULL, NULL, 'bad value in ' || concat_ws(',', CASE WHEN TRY_CAST(cust AS BIGINT) IS NULL THEN 'cust' END,
           CASE WHEN TRY_CAST(day AS DATE) IS NULL THEN 'day' END)
    FROM x WHERE TRY_CAST(cust AS BIGINT) IS NULL OR TRY_CAST(day AS DATE) IS NULL""")
def stage_typed_cast(t: Tables):
    text = t.orders.select(
        "o_orderkey", F.when(c("o_orderstatus") == "P", "n/a").otherwise(c("o_custkey").cast("string")).alias("cust"),
        F.when(c("o_orderpriority").startswith("5"), "none").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    )
    out = project.typed_cast(text, [("cust", "bigint"), ("day", "date")])
    main = out.main.select("o_orderkey", "cust", F.date_format("day", "yyyy-MM-dd").alias("day"),
                           F.lit(None).cast("string").alias("reason"))
    none = F.lit(None)
    return main.unionByName(out.reject.select(
        "o_orderkey", none.cast("bigint").alias("cust"), none.cast("string").alias("day"),
        c("_reject_reason").alias("reason"),
    ))


# --- joins -----------------------------------------------------------------------------------

def active_customers(t: Tables) -> DataFrame:
    """A reference side that misses some orders' customers."""
    return t.customer.where("c_acctbal > 2000").select(
        c("c_custkey").alias("custkey"), c("c_name").alias("name"), c("c_mktsegment").alias("segment")
    )


def order_rows(t: Tables, settled: bool = False) -> DataFrame:
    """Orders; only the settled ones where a query needs customers without any order."""
    return (t.orders.where("o_orderstatus <> 'P'") if settled else t.orders).select(
        c("o_custkey").alias("custkey"), c("o_orderkey").alias("orderkey"), c("o_totalprice").alias("price")
    )


SETTLED = " WHERE o_orderstatus <> 'P'"
JOIN_SQL = """
    WITH l AS (SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_totalprice AS price FROM orders{settled}),
         r AS (SELECT c_custkey AS custkey, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_acctbal > 2000)
    SELECT custkey, orderkey, price, name, segment FROM l {how} JOIN r USING (custkey)"""


def _join(name: str, how: str, sql_how: str) -> None:
    settled = how in ("RightOuter", "FullOuter")

    @query(name, JOIN_SQL.format(how=sql_how, settled=SETTLED if settled else ""))
    def run(t: Tables):
        return joins.join_stage(order_rows(t, settled), active_customers(t), ["custkey"], how)


_join("join_inner", "Inner", "INNER")
_join("join_left", "LeftOuter", "LEFT")
_join("join_right", "RightOuter", "RIGHT")
_join("join_full", "FullOuter", "FULL")
_join("join_unknown_type", "NoSuchJoin", "INNER")


@query("join_cross", """
    SELECT r_name, n_name, o_orderpriority, count(*) AS n FROM orders, nation, region WHERE n_regionkey = r_regionkey
    GROUP BY ALL""")
def join_cross(t: Tables):
    geo = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select("r_name", "n_name")
    return joins.cross(t.orders.select("o_orderpriority"), geo).groupBy(
        "r_name", "n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("stage_by_properties_filter", """
    SELECT 'main' AS branch, o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P'
    UNION ALL SELECT 'reject', o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 1000 AND o_orderstatus <> 'P', false)""")
def stage_by_properties_filter(t: Tables):
    stage = {"stage_type": "PxFilter", "properties": {"FilterCondition": "o_totalprice > 1000 AND o_orderstatus <> 'P'"}}
    out = by_properties.apply_stage(stage, t.orders)
    return out.main.select(F.lit("main").alias("branch"), "o_orderkey").unionByName(
        out.reject.select(F.lit("reject").alias("branch"), "o_orderkey"))


@query("stage_by_properties_join", JOIN_SQL.format(how="LEFT", settled=""))
def stage_by_properties_join(t: Tables):
    stage = {"stage_type": "PxJoin", "properties": {"JoinType": "LeftOuter", "JoinKey": "custkey"}}
    return by_properties.apply_stage(stage, order_rows(t), active_customers(t)).main


@query("stage_by_properties_lookup", """
    SELECT o_orderkey AS orderkey, 'No match on custkey' AS reason FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)""")
def stage_by_properties_lookup(t: Tables):
    stage = {"stage_type": "PxLookup", "properties": {"LookupKey": "custkey", "NoMatchHandling": "Reject"}}
    return by_properties.apply_stage(stage, order_rows(t), active_customers(t)).reject.select(
        "orderkey", c("_reject_reason").alias("reason"))


@query("stage_by_properties_aggregate", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most, CAST(count(l_shipdate) AS BIGINT) AS dated
    FROM lineitem GROUP BY ALL""")
def stage_by_properties_aggregate(t: Tables):
    stage = {"stage_type": "PxAggregate", "properties": {
        "GroupByKeys": "l_returnflag, l_linestatus", "Aggregations": "COUNT(*) AS n, MAX(l_quantity) AS most, COUNT(l_shipdate) AS dated"}}
    return by_properties.apply_stage(stage, t.lineitem).main


@query("stage_by_properties_sort", "SELECT p_partkey, p_size, p_name FROM part")
def stage_by_properties_sort(t: Tables):
    stage = {"stage_type": "PxSort", "properties": {"SortKeys": "p_size DESC, p_name ASC"}}
    return by_properties.apply_stage(stage, t.part.select("p_partkey", "p_size", "p_name")).main


@query("join_left_with_reject", """
    SELECT 'main' AS branch, o_orderkey AS orderkey, c_name AS name, NULL AS reason
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 2000
    UNION ALL SELECT 'reject', o_orderkey, NULL, 'No match on custkey' FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)""")
def join_left_with_reject(t: Tables):
    out = joins.join_with_reject(order_rows(t), active_customers(t), ["custkey"])
    none = F.lit(None).cast("string")
    return out.main.select(F.lit("main").alias("branch"), "orderkey", "name", none.alias("reason")).unionByName(
        out.reject.select(F.lit("reject").alias("branch"), "orderkey", none.alias("name"),
                          c("_reject_reason").alias("reason")))


@query("join_multi_key", """
    WITH stock AS (SELECT l_partkey AS partkey, l_suppkey AS suppkey, count(*) AS lines FROM lineitem GROUP BY ALL),
         sold AS (SELECT l_partkey AS partkey, l_suppkey AS suppkey, max(l_quantity) AS best FROM lineitem
                  WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT partkey, suppkey, lines, best FROM stock JOIN sold USING (partkey, suppkey)""")
def join_multi_key(t: Tables):
    li = t.lineitem.select(c("l_partkey").alias("partkey"), c("l_suppkey").alias("suppkey"), "l_quantity", "l_returnflag")
    keys = ["partkey", "suppkey"]
    stock = li.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"))
    sold = li.where("l_returnflag = 'R'").groupBy(*keys).agg(F.max("l_quantity").alias("best"))
    return joins.join_stage(stock, sold, keys, "Inner")


# --- lookups ---------------------------------------------------------------------------------

def item_lines(t: Tables) -> DataFrame:
    return t.lineitem.select(c("l_partkey").alias("partkey"), c("l_orderkey").alias("orderkey"),
                             c("l_linenumber").alias("line"), c("l_quantity").alias("quantity"))


def items(t: Tables) -> DataFrame:
    """An item reference that misses some parts."""
    return t.part.where("p_size > 10").select(
        c("p_partkey").alias("partkey"), c("p_brand").alias("brand"), c("p_type").alias("type"))


LOOKUP_SQL = """
    WITH l AS (SELECT l_partkey AS partkey, l_orderkey AS orderkey, l_linenumber AS line, l_quantity AS quantity FROM lineitem),
         r AS (SELECT p_partkey AS partkey, p_brand AS brand, p_type AS type, 1 AS hit FROM part WHERE p_size > 10)"""


@query("lookup_continue", LOOKUP_SQL + """
    SELECT partkey, orderkey, line, quantity, CASE WHEN hit IS NULL THEN 'UNKNOWN' ELSE brand END AS brand, type
    FROM l LEFT JOIN r USING (partkey)""")
def lookup_continue(t: Tables):
    return joins.lookup(item_lines(t), items(t), ["partkey"], "Continue", {"brand": "UNKNOWN"}).main


@query("lookup_drop", LOOKUP_SQL + " SELECT partkey, orderkey, line, quantity, brand, type FROM l JOIN r USING (partkey)")
def lookup_drop(t: Tables):
    return joins.lookup(item_lines(t), items(t), ["partkey"], "Drop").main


@query("lookup_reject", LOOKUP_SQL + """
    SELECT partkey, orderkey, line, quantity, 'No match on partkey' AS reason FROM l ANTI JOIN r USING (partkey)""")
def lookup_reject(t: Tables):
    return joins.lookup(item_lines(t), items(t), ["partkey"], "Reject").reject.withColumnRenamed("_reject_reason", "reason")


@query("lookup_fail", """
    SELECT p_brand AS brand, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def lookup_fail(t: Tables):
    every = t.part.select(c("p_partkey").alias("partkey"), c("p_brand").alias("brand"))
    return joins.lookup(item_lines(t), every, ["partkey"], "Fail").main.groupBy("brand").agg(F.count(F.lit(1)).alias("lines"))


@query("lookup_threshold", LOOKUP_SQL + """
    SELECT brand, type, count(*) AS lines, CAST(sum(CAST(quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
    FROM l JOIN r USING (partkey) GROUP BY ALL""")
def lookup_threshold(t: Tables):
    """A reference the caller knows to be too large for a broadcast: the sort-merge way."""
    main = joins.lookup(item_lines(t), items(t), ["partkey"], "Drop", how="merge").main
    return main.groupBy("brand", "type").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(money("quantity")).cast("double").alias("quantity"))


@query("lookup_dedup_reference", """
    WITH r AS (SELECT l_partkey, l_suppkey FROM lineitem
               QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) = 1)
    SELECT p_partkey AS partkey, p_brand AS brand, l_suppkey AS first_supplier FROM part LEFT JOIN r ON p_partkey = l_partkey""")
def lookup_dedup_reference(t: Tables):
    ref = joins.one_per_key(
        t.lineitem.select(c("l_partkey").alias("partkey"), c("l_suppkey").alias("first_supplier"), "l_shipdate",
                          "l_orderkey", "l_linenumber"),
        ["partkey"], [c("l_shipdate"), c("l_orderkey"), c("l_linenumber"), c("first_supplier")],
    ).select("partkey", "first_supplier")
    parts = t.part.select(c("p_partkey").alias("partkey"), c("p_brand").alias("brand"))
    return joins.lookup(parts, ref, ["partkey"], "Continue").main


# --- aggregation -----------------------------------------------------------------------------

KEYS = ["l_returnflag", "l_linestatus"]
AGG = "SELECT l_returnflag, l_linestatus, {} FROM lineitem GROUP BY ALL"


@query("agg_sum", AGG.format("CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total"))
def agg_sum(t: Tables):
    return agg.aggregate(t.lineitem, KEYS, {"total": F.sum(money("l_extendedprice")).cast("double")})


@query("agg_count", AGG.format("count(nullif(l_linenumber, 1)) AS present, count(*) AS n"))
def agg_count(t: Tables):
    return agg.aggregate(t.lineitem, KEYS, {
        "present": agg.AGGREGATES["COUNT"](F.nullif("l_linenumber", F.lit(1))), "n": F.count(F.lit(1))})


@query("agg_avg", AGG.format("CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS mean"))
def agg_avg(t: Tables):
    return agg.aggregate(t.lineitem, KEYS, {"mean": F.sum(money("l_quantity")).cast("double") / F.count("l_quantity")})


@query("agg_max_min", AGG.format("max(l_extendedprice) AS highest, min(l_extendedprice) AS lowest"))
def agg_max_min(t: Tables):
    a = agg.AGGREGATES
    return agg.aggregate(t.lineitem, KEYS, {"highest": a["MAX"](c("l_extendedprice")), "lowest": a["MIN"](c("l_extendedprice"))})


@query("agg_stddev_variance", AGG.format("round(stddev(l_quantity), 6) AS sd, round(variance(l_quantity), 6) AS var"))
def agg_stddev_variance(t: Tables):
    a = agg.AGGREGATES
    return agg.aggregate(t.lineitem, KEYS, {
        "sd": F.round(a["STDDEV"](c("l_quantity")), 6), "var": F.round(a["VARIANCE"](c("l_quantity")), 6)})


@query("agg_first_last", """
    SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order,
           arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY ALL""")
def agg_first_last(t: Tables):
    order = ["o_orderdate", "o_orderkey"]
    return agg.aggregate(t.orders, ["o_custkey"], {
        "first_order": agg.first_by("o_orderkey", order), "last_order": agg.last_by("o_orderkey", order)})


@query("agg_collect_list", """
    SELECT o_custkey, CAST((nth - 1) // 4 AS BIGINT) AS piece, array_to_string(list_sort(list(o_orderkey)), ',') AS orders
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) GROUP BY ALL""")
def agg_collect_list(t: Tables):
    lists = agg.collect_pieces(t.orders, ["o_custkey"], "o_orderkey", 4, "orders")
    return lists.withColumn("orders", F.array_join(c("orders").cast("array<string>"), ","))


@query("agg_daily_summary", SALES_SQL + """
    SELECT r_name AS "REGION", c_mktsegment AS "SEGMENT", CAST(year(d) AS INTEGER) AS "SALE_YEAR",
           CAST(month(d) AS INTEGER) AS "SALE_MONTH", CAST(sum(net) AS DOUBLE) AS "TOTAL_REVENUE",
           count(l_orderkey) AS "TOTAL_ORDERS", CAST(sum(net) AS DOUBLE) / count(net) AS "AVG_ORDER_VALUE",
           CAST(max(net) AS DOUBLE) AS "MAX_ORDER_VALUE"
    FROM derived GROUP BY ALL""")
def agg_daily_summary(t: Tables):
    return customer_sales.summarize(customer_sales.transform(customers(t), sales(t), **SALE_OPTIONS))
