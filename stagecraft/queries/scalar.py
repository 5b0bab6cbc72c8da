"""One query per scalar function, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

from stagecraft.functions import BY_NAME, Routines, dates, maths, nulls, strings
from stagecraft.queries.registry import Tables, query

RUN_DATE = "2024-06-30"
RUN_TIME = "2024-06-30 12:34:56"

c = F.col


def _day(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd")


def _stamp(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss")


def _bit(x: Column) -> Column:
    return F.when(x, 1).otherwise(0)


def rough() -> Column:
    return F.when(c("o_orderstatus") == "F", F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).otherwise(c("o_orderstatus"))


ROUGH_SQL = "CASE WHEN o_orderstatus = 'F' THEN split_part(o_orderpriority, '-', 1) ELSE o_orderstatus END"


def date_text() -> Column:
    return F.when(c("o_orderstatus") == "P", "bad date").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))


DATE_TEXT_SQL = "CASE WHEN o_orderstatus = 'P' THEN 'bad date' ELSE strftime(o_orderdate, '%d.%m.%Y') END"


def gap() -> Column:
    return F.nullif(c("c_nationkey"), F.lit(3))


GAP_SQL = "nullif(c_nationkey, 3)"

IDS = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "events": "event_id"}

# query, table, Column (built once a session is there), SQL
CASES: list[tuple[str, str, Callable[[], Column], str]] = [
    ("fn_upcase", "part", lambda: strings.upcase("p_name"), "upper(p_name)"),
    ("fn_downcase", "customer", lambda: strings.downcase("c_mktsegment"), "lower(c_mktsegment)"),
    ("fn_trim", "customer", lambda: strings.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))), "trim('  ' || c_name || ' ')"),
    ("fn_ltrim", "customer", lambda: strings.ltrim(F.concat(F.lit("  "), "c_name", F.lit(" "))), "ltrim('  ' || c_name || ' ')"),
    ("fn_rtrim", "customer", lambda: strings.rtrim(F.concat(F.lit("  "), "c_name", F.lit(" "))), "rtrim('  ' || c_name || ' ')"),
    ("fn_length", "part", lambda: strings.length("p_name"), "CAST(length(p_name) AS INTEGER)"),
    ("fn_left", "part", lambda: strings.left("p_name", 3), "substring(p_name, 1, 3)"),
    ("fn_right", "part", lambda: strings.right("p_name", 12), "right(p_name, 12)"),
    ("fn_mid", "part", lambda: strings.mid("p_type", 2, 3), "substring(p_type, 2, 3)"),
    ("fn_index", "part", lambda: strings.index("p_name", "e", 2),
     "CAST(CASE WHEN len(string_split(p_name, 'e')) > 2 THEN length(array_to_string("
     "list_slice(string_split(p_name, 'e'), 1, 2), 'e')) + 1 ELSE 0 END AS INTEGER)"),
    ("fn_index_first", "part", lambda: strings.index("p_name", "in"), "CAST(instr(p_name, 'in') AS INTEGER)"),
    ("fn_field", "orders", lambda: strings.field("o_orderpriority", "-", 2), "split_part(o_orderpriority, '-', 2)"),
    ("fn_char", "orders", lambda: strings.char("o_orderkey"), "CAST(o_orderkey AS VARCHAR)"),
    ("fn_str", "customer", lambda: strings.str_("c_nationkey"), "CAST(c_nationkey AS VARCHAR)"),
    ("fn_num", "orders", lambda: strings.num(rough()), f"TRY_CAST({ROUGH_SQL} AS DOUBLE)"),
    ("fn_space", "part", lambda: F.concat(F.lit("["), strings.space(c("p_size")), F.lit("]")), "'[' || repeat(' ', p_size) || ']'"),
    ("fn_convert", "customer", lambda: strings.convert("#0", "-o", "c_name"), "translate(c_name, '#0', '-o')"),
    ("fn_concat", "customer", lambda: strings.concat("c_name", F.lit(" / "), F.nullif(c("c_mktsegment"), F.lit("MACHINERY"))),
     "c_name || ' / ' || nullif(c_mktsegment, 'MACHINERY')"),
    ("fn_year", "orders", lambda: dates.year("o_orderdate"), "CAST(year(o_orderdate) AS INTEGER)"),
    ("fn_month", "orders", lambda: dates.month("o_orderdate"), "CAST(month(o_orderdate) AS INTEGER)"),
    ("fn_day", "orders", lambda: dates.day("o_orderdate"), "CAST(day(o_orderdate) AS INTEGER)"),
    ("fn_hour", "events", lambda: dates.hour("ts"), "CAST(hour(ts) AS INTEGER)"),
    ("fn_minute", "events", lambda: dates.minute("ts"), "CAST(minute(ts) AS INTEGER)"),
    ("fn_second", "events", lambda: dates.second("ts"), "CAST(second(ts) AS INTEGER)"),
    ("fn_day_of_week", "orders", lambda: dates.day_of_week("o_orderdate"), "CAST(dayofweek(o_orderdate) + 1 AS INTEGER)"),
    ("fn_week_of_year", "orders", lambda: dates.week_of_year("o_orderdate"), "CAST(weekofyear(o_orderdate) AS INTEGER)"),
    ("fn_quarter", "orders", lambda: dates.quarter("o_orderdate"), "CAST(quarter(o_orderdate) AS INTEGER)"),
    ("fn_current_date", "orders", lambda: dates.date_diff(dates.current_date(RUN_DATE), c("o_orderdate")),
     f"CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{RUN_DATE}') AS INTEGER)"),
    ("fn_current_time", "orders", lambda: F.concat(_stamp(dates.current_time(RUN_TIME)), "o_orderstatus"), f"'{RUN_TIME}' || o_orderstatus"),
    ("fn_current_timestamp", "orders", lambda: F.concat(_stamp(dates.current_timestamp(RUN_TIME)), "o_orderstatus"),
     f"'{RUN_TIME}' || o_orderstatus"),
    ("fn_date_from_components", "orders", lambda: _day(dates.date_from_components(F.year("o_orderdate"), 12, F.dayofmonth("o_orderdate"))),
     "strftime(make_date(year(o_orderdate), 12, day(o_orderdate)), '%Y-%m-%d')"),
    ("fn_timestamp_from_components", "events",
     lambda: _stamp(dates.timestamp_from_components(2024, F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), 30, 15)),
     "strftime(make_timestamp(2024, month(ts), day(ts), hour(ts), 30, 15.0), '%Y-%m-%d %H:%M:%S')"),
    ("fn_days_after", "orders", lambda: _day(dates.days_after(45, "o_orderdate")),
     "strftime(CAST(o_orderdate AS DATE) + 45, '%Y-%m-%d')"),
    ("fn_days_before", "orders", lambda: _day(dates.days_before(45, "o_orderdate")),
     "strftime(CAST(o_orderdate AS DATE) - 45, '%Y-%m-%d')"),
    ("fn_date_diff", "orders", lambda: dates.date_diff("o_orderdate", F.lit("1996-02-29").cast("date")),
     "CAST(date_diff('day', DATE '1996-02-29', CAST(o_orderdate AS DATE)) AS INTEGER)"),
    ("fn_month_diff", "orders", lambda: F.round(dates.month_diff(c("o_orderdate").cast("date"), F.lit("1996-01-15").cast("date")), 6),
     "round((year(o_orderdate) - 1996) * 12 + month(o_orderdate) - 1 + (day(o_orderdate) - 15) / 31.0, 6)"),
    ("fn_date_to_string", "orders", lambda: dates.date_to_string("o_orderdate", "yyyy/MM/dd"), "strftime(o_orderdate, '%Y/%m/%d')"),
    ("fn_string_to_date", "orders", lambda: _day(dates.string_to_date(date_text(), "dd.MM.yyyy")),
     f"strftime(try_strptime({DATE_TEXT_SQL}, '%d.%m.%Y'), '%Y-%m-%d')"),
    ("fn_abs", "customer", lambda: maths.abs_(c("c_acctbal") - 5000.0), "abs(c_acctbal - 5000.0::DOUBLE)"),
    ("fn_sqrt", "part", lambda: maths.sqrt("p_retailprice"), "sqrt(p_retailprice)"),
    ("fn_round", "customer", lambda: maths.round_(c("c_acctbal").cast("decimal(18,2)"), 1).cast("double"),
     "CAST(round(CAST(c_acctbal AS DECIMAL(18,2)), 1) AS DOUBLE)"),
    ("fn_floor", "customer", lambda: maths.floor("c_acctbal"), "CAST(floor(c_acctbal) AS BIGINT)"),
    ("fn_ceiling", "customer", lambda: maths.ceiling("c_acctbal"), "CAST(ceil(c_acctbal) AS BIGINT)"),
    ("fn_mod", "customer", lambda: maths.mod(c("c_custkey") - 700, "c_nationkey"),
     "CASE WHEN c_nationkey = 0 THEN NULL ELSE (c_custkey - 700) % c_nationkey END"),
    ("fn_power", "part", lambda: maths.power("p_size", 2), "power(p_size, 2)::DOUBLE"),
    ("fn_log", "part", lambda: F.round(maths.log("p_retailprice"), 6), "round(ln(p_retailprice), 6)"),
    ("fn_exp", "part", lambda: F.round(maths.exp(c("p_size") / 10.0), 4), "round(exp(p_size / 10.0::DOUBLE), 4)"),
    ("fn_sign", "customer", lambda: maths.sign(c("c_acctbal") - 5000.0).cast("int"), "CAST(sign(c_acctbal - 5000.0::DOUBLE) AS INTEGER)"),
    ("fn_checksum", "customer", lambda: maths.checksum("c_name", gap(), "c_mktsegment"),
     f"sha256(concat_ws('|', c_name, coalesce(CAST({GAP_SQL} AS VARCHAR), ''), c_mktsegment))"),
    ("fn_is_null", "customer", lambda: _bit(nulls.is_null(gap())), f"CASE WHEN {GAP_SQL} IS NULL THEN 1 ELSE 0 END"),
    ("fn_is_not_null", "customer", lambda: _bit(nulls.is_not_null(gap())), f"CASE WHEN {GAP_SQL} IS NOT NULL THEN 1 ELSE 0 END"),
    ("fn_is_void", "customer", lambda: _bit(nulls.is_void(gap())), f"CASE WHEN {GAP_SQL} IS NULL THEN 1 ELSE 0 END"),
    ("fn_nvl", "customer", lambda: nulls.nvl(gap(), -1), f"coalesce({GAP_SQL}, -1)"),
    ("fn_null_to_value", "customer", lambda: nulls.null_to_value(gap(), 99), f"coalesce({GAP_SQL}, 99)"),
    ("fn_conditional", "customer",
     lambda: nulls.conditional([(c("c_acctbal") > 7500, "HIGH"), (c("c_acctbal") > 2500, "MID")], "LOW"),
     "CASE WHEN c_acctbal > 7500 THEN 'HIGH' WHEN c_acctbal > 2500 THEN 'MID' ELSE 'LOW' END"),
    # The integer hash and random numbers have no SQL twin in another engine.
    ("fn_checksum_murmur3", "customer", lambda: maths.checksum("c_name", "c_mktsegment", algorithm="murmur3"), ""),
    ("fn_random", "customer", lambda: maths.random(7), ""),
]


def _register(name: str, source: str, column: Callable[[], Column], sql: str) -> None:
    key = IDS[source]

    @query(name, f"SELECT {key}, {sql} AS value FROM {source}" if sql else None)
    def run(t: Tables):
        return getattr(t, source).select(key, column().alias("value"))


for _case in CASES:
    _register(*_case)


@query("udf_custom_routine", """
    SELECT c_custkey, upper(c_mktsegment) || '-' || CAST(c_nationkey AS VARCHAR) AS code,
           CAST(((c_custkey * 10 + 7) % 97) AS BIGINT) AS check_digit
    FROM customer""")
def custom_routine(t: Tables):
    @F.pandas_udf("bigint")
    def check_digit(key: pd.Series) -> pd.Series:
        return (key * 10 + 7) % 97

    routines = Routines()
    routines.add("SegmentCode", lambda seg, nat: F.concat(BY_NAME["Upcase"](seg), F.lit("-"), c(nat).cast("string")))
    routines.add_arrow("CheckDigit", check_digit)
    routines.register_for_sql(t.spark)
    return t.customer.select(
        "c_custkey", routines["SegmentCode"]("c_mktsegment", "c_nationkey").alias("code"),
        F.expr("CheckDigit(c_custkey)").alias("check_digit"),
    )
