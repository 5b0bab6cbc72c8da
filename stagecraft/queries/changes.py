"""Dedup, keys, change data, dimensions, reshape, sort and partition queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagecraft.functions.maths import checksum
from stagecraft.operators import changes, joins, shape
from stagecraft.operators.cells import width_cells
from stagecraft.queries.registry import Tables, query

c = F.col


def _day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


DEDUP = """
    SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey
      ORDER BY l_shipdate {0}, l_orderkey {0}, l_linenumber {0}, l_extendedprice {0}) = 1"""
DEDUP_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]


def _dedup(name: str, keep: str, direction: str) -> None:
    @query(name, DEDUP.format(direction))
    def run(t: Tables):
        rows = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", *DEDUP_ORDER)
        return changes.dedup(rows, ["l_partkey", "l_suppkey"], DEDUP_ORDER, keep).select(
            "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


_dedup("dedup_keep_first", "first", "ASC")
_dedup("dedup_keep_last", "last", "DESC")


@query("rank_functions", """
    SELECT o_custkey, o_orderkey, row_number() OVER w AS row_number,
           rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rank,
           strftime(lead(o_orderdate) OVER w, '%Y-%m-%d') AS next_value
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def rank_functions(t: Tables):
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return changes.rank_rows(orders, ["o_custkey"], "o_orderdate", "o_orderkey").select(
        "o_custkey", "o_orderkey", "row_number", "rank", _day("next_value"))


@query("surrogate_key", """
    WITH dim AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS sk FROM customer WHERE c_acctbal < 3000)
    SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) + (SELECT max(sk) FROM dim) AS sk
    FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM dim)""")
def surrogate_key(t: Tables):
    keys = t.customer.select("c_custkey", "c_acctbal")
    dim = changes.surrogate_key(keys.where("c_acctbal < 3000"), "c_custkey").select("c_custkey", "sk")
    return changes.assign_surrogate_keys(dim, keys.select("c_custkey"), "c_custkey")


@query("surrogate_key_text", "SELECT c_name, row_number() OVER (ORDER BY c_name) AS sk FROM customer")
def surrogate_key_text(t: Tables):
    return changes.surrogate_key(t.customer.select("c_name"), "c_name")


@query("record_hash", """
    SELECT c_custkey, sha256(concat_ws('|', c_name, coalesce(nullif(c_mktsegment, 'MACHINERY'), ''),
           CAST(c_nationkey AS VARCHAR), CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR))) AS record_hash FROM customer""")
def record_hash(t: Tables):
    rows = t.customer.select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"),
                             "c_nationkey", c("c_acctbal").cast("decimal(18,2)").alias("balance"))
    return changes.with_record_hash(rows, ["c_name", "segment", "c_nationkey", "balance"]).select("c_custkey", "record_hash")


# --- two images of the customer table ----------------------------------------------------------
# before: without the FURNITURE segment; after: without MACHINERY, low balances raised.

IMAGES = """
    WITH before AS (SELECT c_custkey AS id, c_name AS name, nullif(c_nationkey, 7) AS nation, c_acctbal AS balance
                    FROM customer WHERE c_mktsegment <> 'FURNITURE'),
         after AS (SELECT c_custkey AS id, c_name AS name, nullif(c_nationkey, 7) AS nation,
                   CASE WHEN c_acctbal < 1500 THEN c_acctbal + 100 ELSE c_acctbal END AS balance
                   FROM customer WHERE c_mktsegment <> 'MACHINERY')"""


def before(t: Tables) -> DataFrame:
    return t.customer.where("c_mktsegment <> 'FURNITURE'").select(
        c("c_custkey").alias("id"), c("c_name").alias("name"), F.nullif("c_nationkey", F.lit(7)).alias("nation"),
        c("c_acctbal").alias("balance"))


def after(t: Tables) -> DataFrame:
    raised = F.when(c("c_acctbal") < 1500, c("c_acctbal") + 100).otherwise(c("c_acctbal"))
    return t.customer.where("c_mktsegment <> 'MACHINERY'").select(
        c("c_custkey").alias("id"), c("c_name").alias("name"), F.nullif("c_nationkey", F.lit(7)).alias("nation"),
        raised.alias("balance"))


VALUES = ["name", "nation", "balance"]


@query("change_capture", IMAGES + """
    SELECT coalesce(a.id, b.id) AS id,
           CASE WHEN b.id IS NULL THEN 'insert' WHEN a.id IS NULL THEN 'delete'
                WHEN b.name IS NOT DISTINCT FROM a.name AND b.nation IS NOT DISTINCT FROM a.nation
                 AND b.balance IS NOT DISTINCT FROM a.balance THEN 'unchanged' ELSE 'update' END AS change,
           b.name AS old_name, b.nation AS old_nation, b.balance AS old_balance,
           a.name AS new_name, a.nation AS new_nation, a.balance AS new_balance
    FROM before b FULL JOIN after a ON a.id = b.id""")
def change_capture(t: Tables):
    return changes.change_capture(before(t), after(t), ["id"], VALUES)


UPSERT = IMAGES + """
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN b.name ELSE a.name END AS name,
           CASE WHEN a.id IS NULL THEN b.nation ELSE a.nation END AS nation,
           CASE WHEN a.id IS NULL THEN b.balance ELSE a.balance END AS balance
    FROM before b FULL JOIN after a ON a.id = b.id"""


@query("merge_upsert", UPSERT)
def merge_upsert(t: Tables):
    return changes.merge_upsert(before(t), after(t), ["id"])


@query("scd1", IMAGES + """
    SELECT coalesce(a.id, b.id) AS id, b.name AS name, b.nation AS nation,
           CASE WHEN a.id IS NULL THEN b.balance ELSE a.balance END AS balance
    FROM before b FULL JOIN after a ON a.id = b.id""")
def scd1(t: Tables):
    return changes.scd1(before(t), after(t).select("id", "balance"), ["id"])


@query("merge_update_reject", IMAGES + """
    SELECT id, name, nation, balance, 'No match on id' AS reason FROM after WHERE id NOT IN (SELECT id FROM before)""")
def merge_update_reject(t: Tables):
    return changes.merge_update_reject(before(t), after(t), ["id"]).withColumnRenamed("_reject_reason", "reason")


@query("change_apply", IMAGES + " SELECT id, name, nation, balance FROM after")
def change_apply(t: Tables):
    delta = changes.change_capture(before(t), after(t), ["id"], VALUES)
    return changes.change_apply(before(t), delta, ["id"], VALUES)


# --- versions: the price of a part over the days it was shipped ---------------------------------

VERSIONS = """
    WITH versions AS (SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS start, CAST(round(max(l_tax) * 100) AS INTEGER) AS rate
                      FROM lineitem GROUP BY ALL)"""


def versions(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(c("l_partkey").alias("part"), c("l_shipdate").cast("date").alias("start")).agg(
        F.round(F.max("l_tax") * 100).cast("int").alias("rate"))


@query("scd2_history", VERSIONS + """
    SELECT part, strftime(start, '%Y-%m-%d') AS start, rate,
           coalesce(strftime(lead(start) OVER w, '%Y-%m-%d'), '9999-12-31') AS eff_end_date,
           CASE WHEN lead(start) OVER w IS NULL THEN 1 ELSE 0 END AS is_current_flag
    FROM versions WINDOW w AS (PARTITION BY part ORDER BY start)""")
def scd2_history(t: Tables):
    out = changes.scd2_history(versions(t), ["part"], ["start"])
    return out.select("part", _day("start"), "rate", F.date_format("EFF_END_DATE", "yyyy-MM-dd").alias("eff_end_date"),
                      c("IS_CURRENT_FLAG").alias("is_current_flag"))


COLLAPSED = VERSIONS + """,
    collapsed AS (SELECT * FROM versions
      QUALIFY rate IS DISTINCT FROM lag(rate) OVER (PARTITION BY part ORDER BY start))"""


@query("scd2_collapse_unchanged", COLLAPSED + """
    SELECT part, strftime(start, '%Y-%m-%d') AS start, rate FROM collapsed""")
def scd2_collapse_unchanged(t: Tables):
    return changes.collapse_unchanged(versions(t), ["part"], ["start"], ["rate"]).select("part", _day("start"), "rate")


@query("scd3", VERSIONS + """
    SELECT part, max(CASE WHEN rn = 1 THEN rate END) AS current_value, max(CASE WHEN rn = 2 THEN rate END) AS previous_value
    FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY start DESC) AS rn FROM versions) GROUP BY ALL""")
def scd3(t: Tables):
    return changes.scd3(versions(t), ["part"], ["start"], "rate")


HISTORY = VERSIONS + """,
    dim AS (SELECT part, rate, start AS s, coalesce(lead(start) OVER (PARTITION BY part ORDER BY start), DATE '9999-12-31') AS e
            FROM versions)"""


def dimension(t: Tables) -> DataFrame:
    out = changes.scd2_history(versions(t), ["part"], ["start"])
    return out.withColumnRenamed("start", "EFF_START_DATE")


@query("scd2_point_in_time", HISTORY + """
    SELECT part, rate, strftime(s, '%Y-%m-%d') AS since FROM dim WHERE s <= DATE '1998-07-01' AND DATE '1998-07-01' < e""")
def scd2_point_in_time(t: Tables):
    return changes.as_of(dimension(t), "1998-07-01").select("part", "rate", F.date_format("EFF_START_DATE", "yyyy-MM-dd").alias("since"))


@query("scd2_merge", VERSIONS + """,
    h AS (SELECT part, rate, start, lead(start) OVER (PARTITION BY part ORDER BY start) AS nxt FROM versions WHERE start < DATE '1999-01-01'),
    snap AS (SELECT part, arg_max(rate, start) AS rate FROM versions GROUP BY ALL)
    SELECT part, rate, strftime(start, '%Y-%m-%d') AS since, strftime(nxt, '%Y-%m-%d') AS until, 0 AS is_current FROM h WHERE nxt IS NOT NULL
    UNION ALL
    SELECT h.part, h.rate, strftime(h.start, '%Y-%m-%d'),
           CASE WHEN h.rate IS DISTINCT FROM s.rate THEN '2002-01-01' ELSE '9999-12-31' END,
           CASE WHEN h.rate IS DISTINCT FROM s.rate THEN 0 ELSE 1 END
    FROM h JOIN snap s ON h.part = s.part WHERE h.nxt IS NULL
    UNION ALL
    SELECT s.part, s.rate, '2002-01-01', '9999-12-31', 1 FROM snap s LEFT JOIN (SELECT * FROM h WHERE nxt IS NULL) h ON h.part = s.part
    WHERE h.part IS NULL OR h.rate IS DISTINCT FROM s.rate""")
def scd2_merge(t: Tables):
    all_versions = versions(t)
    dim = changes.scd2_history(all_versions.where("start < DATE '1999-01-01'"), ["part"], ["start"]).withColumnRenamed(
        "start", "EFF_START_DATE")
    snapshot = all_versions.groupBy("part").agg(F.max_by("rate", "start").alias("rate"))
    out = changes.scd2_merge(dim, snapshot, ["part"], ["rate"], "2002-01-01")
    return out.select("part", "rate", F.date_format("EFF_START_DATE", "yyyy-MM-dd").alias("since"),
                      F.date_format("EFF_END_DATE", "yyyy-MM-dd").alias("until"), c("IS_CURRENT_FLAG").alias("is_current"))


@query("scd2_fact_join", HISTORY + """
    SELECT l_orderkey, l_linenumber, l_partkey AS part, CAST(l_shipdate AS DATE)::VARCHAR AS ship, rate
    FROM lineitem JOIN dim ON l_partkey = part AND s <= CAST(l_shipdate AS DATE) AND CAST(l_shipdate AS DATE) < e""")
def scd2_fact_join(t: Tables):
    facts = t.lineitem.select("l_orderkey", "l_linenumber", c("l_partkey").alias("part"), c("l_shipdate").cast("date").alias("ship"))
    return changes.join_as_of(facts, dimension(t), ["part"], "ship").select(
        "l_orderkey", "l_linenumber", "part", _day("ship"), "rate")


# --- reshape, union, sort, partition -----------------------------------------------------------

@query("stage_pivot", """
    SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS "F_total",
           CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS "O_total",
           CAST(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS "P_total"
    FROM orders GROUP BY ALL""")
def stage_pivot(t: Tables):
    return shape.pivot_rows(t.orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"],
                            {"total": F.sum(c("o_totalprice").cast("decimal(18,2)")).cast("double")})


@query("stage_unpivot", """
    SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_extendedprice', l_extendedprice FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem""")
def stage_unpivot(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax")
    return shape.unpivot_cols(rows, ["l_orderkey", "l_linenumber", "l_partkey"],
                              ["l_quantity", "l_extendedprice", "l_tax"], "measure", "amount")


def _parties(t: Tables) -> DataFrame:
    cust = t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_mktsegment").alias("segment"))
    supp = t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    return shape.funnel(cust, supp)


PARTIES = """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
             UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier"""


@query("funnel_union", PARTIES)
def funnel_union(t: Tables):
    return _parties(t)


@query("funnel_sorted", PARTIES)
def funnel_sorted(t: Tables):
    return shape.sort_rows(_parties(t), "id ASC, name DESC")


@query("stage_sort", """
    SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) ASC NULLS FIRST, prio DESC NULLS LAST, o_orderkey) AS position
    FROM (SELECT *, nullif(o_orderpriority, '2-HIGH') AS prio FROM orders)""")
def stage_sort(t: Tables):
    rows = t.orders.select("o_orderkey", c("o_orderdate").cast("date").alias("day"),
                           F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("prio"))
    return shape.sort_positions(rows, "day ASC, prio DESC", "o_orderkey").select("o_orderkey", "position")


CONTENT = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem"


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("partition_hash", CONTENT)
def partition_hash(t: Tables):
    return shape.partition_hash(_lines(t), 16, "l_partkey")


@query("partition_range", CONTENT)
def partition_range(t: Tables):
    return shape.partition_range(_lines(t), 16, "l_orderkey", "l_linenumber")


@query("partition_round_robin", CONTENT)
def partition_round_robin(t: Tables):
    return shape.partition_round_robin(_lines(t), 16)


@query("partition_same", CONTENT)
def partition_same(t: Tables):
    return shape.partition_same(_lines(t))


@query("partition_entire", """
    SELECT s_name, count(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def partition_entire(t: Tables):
    """A whole copy of the side for every task: a size-checked broadcast."""
    whole = t.supplier.select(c("s_suppkey").alias("l_suppkey"), "s_name")
    return t.lineitem.select("l_suppkey").join(whole, "l_suppkey").groupBy("s_name").agg(F.count(F.lit(1)).alias("lines"))
