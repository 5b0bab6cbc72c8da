"""A job catalog read out of the driver tables, in Spark and as SQL.

A job is an order, a stage is a distinct (order, line number), its links lead to the next and the
second next line; columns, derivations and properties follow from the line's part, supplier and
quantity.  Artifacts are the conversations.  The catalog grows with the tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from stagecraft.catalog.vocab import STAGE_CATEGORIES, column_type_columns, stage_category
from stagecraft.sources.connectors import COLUMN_TYPES
from stagecraft.catalog.gates import ARTIFACTS
from stagecraft.queries.registry import Tables
from stagecraft.runtime import spread, store

TYPES = [
    *STAGE_CATEGORIES, "PxSurrogateKey", "PxDataSet", "CustomStage", "PxUnheardOf",
    "PxTransformer", "PxTransformer", "PxTransformer", "PxTransformer", "PxTransformer", "PxJoin",
]
NAMES = ["ID", "CODE", "QTY", "PRICE", "NAME", "ORDER_DT", "DISCOUNT", "PATH"]
CODES = ["4", "12", "3", "93", "8", "-5", "99", "1"]
MODES = ["MERGE", "OVERWRITE", "APPEND", "REPLACE", "merge", "TRUNCATE"]
JOINS = ["Inner", "LeftOuter", "RightOuter", "FullOuter", "Cross", "Lookup", "Odd"]
AGGS = [
    "SUM(PRICE) AS TOTAL,COUNT(ID) AS N", "max( QTY ) as top, MIN(QTY) AS low",
    "FIRST(CODE) AS a,MEDIAN(QTY) AS mid,broken",
]
EXPRS = [
    "Upcase(Trim(NAME))", "Left(CODE, 3)", "Year(ORDER_DT)", "QTY * PRICE",
    'If QTY > 100 Then "HIGH" Else If QTY = 10 Then "TEN" Else "LOW"', "Nvl(DISCOUNT, 0)",
    "Checksum(ID : CODE)", "Round(PRICE, 2)", "IsNull(CODE)", "DaysAfter(7, ORDER_DT)",
    'DateToString(ORDER_DT, "yyyy-MM-dd")', "Field(PATH, '/', 2)", "Convert('-', '_', CODE)",
    "CurrentDate()", "NAME : ' ' : CODE", "Mod(QTY, 7)", "If CODE Is Null Then 0 Else 1", "QTY",
    "Char(PRICE)", "  Downcase(NAME)  ", "LTrim(CODE)", "Mid(PATH, 2, 3)", "WeekOfYear(ORDER_DT)",
]


def pick(items: list[str], index: Column) -> Column:
    """items[index], 0-based."""
    return F.get(F.array(*[F.lit(x) for x in items]), index.cast("int"))


def column_count(pk: Column, q: Column) -> Column:
    return F.when(pk % 5 == 0, 0).otherwise(q % 4 + 1).cast("int")


def column_fields(pk: Column, sk: Column, i: Column) -> dict[str, Column]:
    """The i-th column of a stage."""
    code = pick(CODES, (sk + i) % 8)
    return {
        "ord": i, "name": pick(NAMES, (pk + i) % 8), "sql_type_code": code,
        "precision": F.when(code.isin("12", "3"), 10 + i), "scale": F.when((code == "3") & (sk % 2 == 0), 2),
        "nullable": (pk + i) % 3 != 0,
    }


def derivation_count(category: Column, sk: Column) -> Column:
    return F.when(category == "transformer", sk % 12).otherwise(0).cast("int")


def derivation_fields(pk: Column, i: Column) -> dict[str, Column]:
    """The i-th derivation of a stage."""
    return {
        "ord": i, "name": F.concat(F.lit("DER_"), i.cast("string")),
        "expression": pick(EXPRS, (pk + i * 5) % len(EXPRS)),
        "output_column": F.when(i % 3 == 0, pick(NAMES, (pk + i) % 8)).otherwise(F.concat(F.lit("D_"), i.cast("string"))),
    }


def below(count: Column, most: int) -> Column:
    """0, 1, ... below ``count``, which is at most ``most``."""
    return F.slice(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(1), F.greatest(count, F.lit(0)))


def stage_name(sk: Column, number: Column) -> Column:
    return F.concat(F.when(sk % 9 == 0, "EXCEPTION_OUT_").otherwise("STAGE_"), number.cast("string"))


def stage_type(pk: Column) -> Column:
    return pick(TYPES, pk % len(TYPES))


def stage_fields(ord: Column, pk: Column, sk: Column, q: Column, st: Column) -> dict[str, Column]:
    """A stage's names, texts and properties, by its numbers and its type."""
    entries = {
        "Connection.DataSource": F.when(pk % 2 == 0, F.concat(F.lit("CONN_"), (sk % 5).cast("string"))),
        "XMLProperties.SelectStatement":
            F.when(q % 10 == 3, F.lit("SELECT ID, EFF_END_DATE FROM DIM_ITEM"))
            .when(q % 10 == 4, F.lit("SELECT ID FROM T WHERE DAY = '${RUN_DAY}'")),
        "XMLProperties.TableName": F.when(pk % 3 == 0, F.concat(F.lit("TX_"), sk.cast("string"))),
        "TableName": F.when(pk % 3 != 2, F.concat(F.lit("T_"), pk.cast("string"))),
        "XMLProperties.WriteMode": F.when(sk % 7 != 0, pick(MODES, sk % 6)),
        "File": F.when(q % 4 == 0, F.lit("/data/in_${DS_RUNDATE}_${REGION}.csv"))
            .when(q % 4 == 1, F.lit("/data/out_${DS_RUNDATE}.csv")),
        "JoinType": F.when(st.isin("PxJoin", "PxLookup"), pick(JOINS, q % 7)),
        "JoinKey": F.when(st == "PxJoin", F.lit("QTY, CODE")),
        "LookupKey": F.when(st == "PxLookup", F.lit("ID")),
        "Aggregations": F.when(st == "PxAggregate", pick(AGGS, q % 3)),
        "Notes": F.when(q == 17, F.lit("Slowly Changing load")),
    }
    # Both lists without their gaps; as joined lists they are compiled, other than a filter with a lambda.
    one_or_none = lambda v, what: F.when(v.isNotNull(), F.array(what)).otherwise(F.array().cast("array<string>"))
    props = F.map_from_arrays(*[F.flatten(F.array(*parts)) for parts in zip(
        *[(one_or_none(v, F.lit(k)), one_or_none(v, v)) for k, v in entries.items()])])
    return {
        "stage_id": stage_name(sk, ord), "category": stage_category(st),
        "description": F.when(q % 2 == 0, "").otherwise("Loads data"),
        "input_pins": (pk % 3).cast("int"), "output_pins": (sk % 4).cast("int"), "props": props,
    }


class Catalog:
    """``shared``: the stages feed several tables of one query, so their numbers are stored once.

    Names, texts and properties follow from the numbers, and a reader makes those it needs itself.
    """

    def __init__(self, t: Tables, shared: bool = False) -> None:
        self.t = t
        self.shared = shared

    @cached_property
    def base(self) -> DataFrame:
        spread(self.t.spark, self.t.folder, "lineitem")
        rows = self.t.lineitem.groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("ord")).agg(
            F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"),
            F.min("l_quantity").cast("bigint").alias("q"),
            # Numbers, not texts: these aggregate by hash.
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"),
            F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("is_open"),
        )
        return store(rows, "stages") if self.shared else rows

    @cached_property
    def staged(self) -> DataFrame:
        fields = stage_fields(*[F.col(k) for k in ("ord", "pk", "sk", "q", "stage_type")])
        return self.base.withColumn("stage_type", stage_type(F.col("pk"))).select("*", *[v.alias(k) for k, v in fields.items()])

    @cached_property
    def stages(self) -> DataFrame:
        return self.staged.select("job_id", "stage_id", "stage_type", "category", "description",
                                  "input_pins", "output_pins", "props")

    @cached_property
    def links(self) -> DataFrame:
        """To the next line, and from a branching stage also to the second next: one equi-join of numbers."""
        steps = F.array_compact(F.array(
            F.when(F.col("returned") == 0, F.lit(1)), F.when(F.col("sk") % 4 > 1, F.lit(2))
        ))
        wanted = self.base.select("job_id", "ord", "sk", F.explode(steps).alias("step")).withColumn("to_ord", F.col("ord") + F.col("step"))
        to = self.base.select("job_id", F.col("ord").alias("to_ord"), F.col("sk").alias("to_sk"))
        return wanted.join(to, ["job_id", "to_ord"]).select(
            "job_id", F.concat(F.lit("L"), F.col("step").cast("string"), F.lit("_"), F.col("ord").cast("string")).alias("link_id"),
            stage_name(F.col("sk"), F.col("ord")).alias("from_stage"), stage_name(F.col("to_sk"), F.col("to_ord")).alias("to_stage"),
            (F.col("step") - 1).alias("from_pin"), F.lit(0).alias("to_pin"),
        )

    @cached_property
    def columns(self) -> DataFrame:
        pk, sk = F.col("pk"), F.col("sk")
        rows = self.staged.select("job_id", "stage_id", "pk", "sk", F.explode(below(column_count(pk, F.col("q")), 4)).alias("ord"))
        fields = column_fields(pk, sk, F.col("ord"))
        return rows.select("job_id", "stage_id", *[v.alias(k) for k, v in fields.items()], *column_type_columns(fields["sql_type_code"]))

    @cached_property
    def derivations(self) -> DataFrame:
        pk = F.col("pk")
        rows = self.staged.select("job_id", "stage_id", "pk", F.explode(below(derivation_count(F.col("category"), F.col("sk")), 12)).alias("ord"))
        return rows.select("job_id", "stage_id", *[v.alias(k) for k, v in derivation_fields(pk, F.col("ord")).items()])

    @cached_property
    def artifacts(self) -> DataFrame:
        return self.t.conversations.select(
            F.col("conv_id").alias("job_id"), pick(list(ARTIFACTS), F.col("turn") % 8).alias("artifact_type"),
            F.length("text").cast("bigint").alias("size_bytes"),
        )


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def case_map(expr: str, mapping: dict[str, str], default: str) -> str:
    """SQL CASE over fixed values."""
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


CATALOG_SQL = f"""
    WITH RECURSIVE base AS (
      SELECT l_orderkey AS job_id, l_linenumber AS ord, min(l_partkey) AS pk, min(l_suppkey) AS sk,
             CAST(min(l_quantity) AS BIGINT) AS q, max(l_returnflag) AS rf, max(l_linestatus) AS ls
      FROM lineitem GROUP BY ALL),
    typed AS (SELECT *, {_list(TYPES)}[pk % {len(TYPES)} + 1] AS stage_type,
      CASE WHEN sk % 9 = 0 THEN 'EXCEPTION_OUT_' ELSE 'STAGE_' END || ord AS stage_id,
      CASE WHEN q % 2 = 0 THEN '' ELSE 'Loads data' END AS description,
      CAST(pk % 3 AS INTEGER) AS input_pins, CAST(sk % 4 AS INTEGER) AS output_pins FROM base),
    stages AS (SELECT *, {case_map('stage_type', STAGE_CATEGORIES, "'unknown'")} AS category,
      CASE WHEN pk % 2 = 0 THEN 'CONN_' || (sk % 5) END AS p_conn,
      CASE WHEN q % 10 = 3 THEN 'SELECT ID, EFF_END_DATE FROM DIM_ITEM'
           WHEN q % 10 = 4 THEN 'SELECT ID FROM T WHERE DAY = ''${{RUN_DAY}}''' END AS p_sql,
      CASE WHEN pk % 3 = 0 THEN 'TX_' || sk WHEN pk % 3 <> 2 THEN 'T_' || pk END AS p_table,
      CASE WHEN sk % 7 <> 0 THEN {_list(MODES)}[sk % 6 + 1] END AS p_mode,
      CASE WHEN q % 4 = 0 THEN '/data/in_${{DS_RUNDATE}}_${{REGION}}.csv'
           WHEN q % 4 = 1 THEN '/data/out_${{DS_RUNDATE}}.csv' END AS p_file,
      CASE WHEN stage_type IN ('PxJoin', 'PxLookup') THEN {_list(JOINS)}[q % 7 + 1] END AS p_jtype,
      CASE WHEN stage_type = 'PxJoin' THEN 'QTY, CODE' END AS p_jkey,
      CASE WHEN stage_type = 'PxLookup' THEN 'ID' END AS p_lkey,
      CASE WHEN stage_type = 'PxAggregate' THEN {_list(AGGS)}[q % 3 + 1] END AS p_agg,
      (q % 10 = 3 OR q = 17) AS mentions_scd
      FROM typed),
    links AS (
      SELECT a.job_id, 'L' || s.step || '_' || a.ord AS link_id, a.stage_id AS from_stage, b.stage_id AS to_stage,
             CAST(s.step - 1 AS INTEGER) AS from_pin, 0 AS to_pin, a.ord AS from_ord, b.ord AS to_ord
      FROM stages a JOIN (VALUES (1), (2)) s(step) ON (s.step = 1 AND a.rf <> 'R') OR (s.step = 2 AND a.output_pins > 1)
      JOIN stages b ON b.job_id = a.job_id AND b.ord = a.ord + s.step),
    columns AS (
      SELECT job_id, stage_id, CAST(i AS INTEGER) AS ord, {_list(NAMES)}[(pk + i) % 8 + 1] AS name,
             {_list(CODES)}[(sk + i) % 8 + 1] AS sql_type_code,
             CASE WHEN {_list(CODES)}[(sk + i) % 8 + 1] IN ('12', '3') THEN CAST(10 + i AS INTEGER) END AS precision,
             CASE WHEN {_list(CODES)}[(sk + i) % 8 + 1] = '3' AND sk % 2 = 0 THEN 2 END AS scale,
             (pk + i) % 3 <> 0 AS nullable
      FROM stages, range(4) r(i) WHERE pk % 5 <> 0 AND i <= q % 4),
    derivations AS (
      SELECT job_id, stage_id, CAST(i AS INTEGER) AS ord, 'DER_' || i AS name,
             {_list(EXPRS)}[(pk + i * 5) % {len(EXPRS)} + 1] AS expression,
             CASE WHEN i % 3 = 0 THEN {_list(NAMES)}[(pk + i) % 8 + 1] ELSE 'D_' || i END AS output_column
      FROM stages, range(12) r(i) WHERE category = 'transformer' AND i < sk % 12),
    artifacts AS (
      SELECT conv_id AS job_id, {_list(ARTIFACTS)}[turn % 8 + 1] AS artifact_type, length(text) AS size_bytes FROM conversations),
    classified AS (
      SELECT s.*, CASE WHEN category = 'source' OR (category = 'source_or_target' AND NOT EXISTS
                         (SELECT 1 FROM links l WHERE l.job_id = s.job_id AND l.to_stage = s.stage_id)) THEN 'source'
                       WHEN category = 'target' OR (category = 'source_or_target' AND NOT EXISTS
                         (SELECT 1 FROM links l WHERE l.job_id = s.job_id AND l.from_stage = s.stage_id)) THEN 'target'
                       ELSE 'transformation' END AS io
      FROM stages s)"""

SQL_TYPES = {k: v[0] for k, v in COLUMN_TYPES.items()}
SPARK_TYPES = {k: v[1] for k, v in COLUMN_TYPES.items()}
