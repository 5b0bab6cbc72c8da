"""Vocabularies of the job catalog, as literal maps inside the plan (no join, no shuffle)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from stagecraft.operators.joins import JOIN_TYPES
from stagecraft.sources.connectors import COLUMN_TYPES, CONNECTORS, UNKNOWN_COLUMN_TYPE
from stagecraft.sources.sinks import WRITE_MODES

# Stage type -> category.
STAGE_CATEGORIES = {
    "PxOracleConnector": "source", "PxDB2Connector": "source", "PxMSSQLConnector": "source",
    "PxPostgresConnector": "source", "PxTeradataConnector": "source",
    "PxSequentialFile": "source_or_target", "PxCsvConnector": "source_or_target",
    "PxS3Connector": "source_or_target",
    "PxBigQueryConnector": "target", "PxSnowflakeConnector": "target", "PxRedshiftConnector": "target",
    "PxTransformer": "transformer", "PxFilter": "filter", "PxJoin": "join",
    "PxAggregate": "aggregation", "PxSort": "sort", "PxSortStage": "sort", "PxLookup": "lookup",
    "PxMerge": "merge", "PxPivot": "pivot", "PxUnpivot": "unpivot", "PxRemoveDup": "dedup",
    "PxChangeCapture": "cdc", "PxCopyStage": "copy", "PxPeekStage": "passthrough",
    "PxFunnel": "union",
}

# Support level per stage type; anything else is unknown.
FULL_SUPPORT = (
    "PxOracleConnector", "PxDB2Connector", "PxMSSQLConnector", "PxPostgresConnector",
    "PxSequentialFile", "PxCsvConnector", "PxBigQueryConnector", "PxSnowflakeConnector",
    "PxTransformer", "PxFilter", "PxJoin", "PxAggregate", "PxSort", "PxSortStage", "PxFunnel",
    "PxCopyStage",
)
PARTIAL_SUPPORT = (
    "PxLookup", "PxMerge", "PxPivot", "PxUnpivot", "PxRemoveDup", "PxPeekStage", "PxS3Connector",
)
COMPLEX_SUPPORT = (
    "PxChangeCapture", "PxSurrogateKey", "PxDataSet", "PxLocalParallelism", "CustomStage",
)

# Aggregate name -> function name.
AGGREGATE_NAMES = {
    "SUM": "F.sum", "COUNT": "F.count", "AVG": "F.avg", "MAX": "F.max", "MIN": "F.min",
    "STDDEV": "F.stddev", "VARIANCE": "F.variance", "FIRST": "F.first", "LAST": "F.last",
    "COLLECT_LIST": "F.collect_list",
}
CONNECTOR_FORMATS = {name: spec[0] for name, spec in CONNECTORS.items()}
SQL_JOIN_TYPES = {
    "Inner": "INNER", "LeftOuter": "LEFT OUTER", "RightOuter": "RIGHT OUTER",
    "FullOuter": "FULL OUTER", "Cross": "CROSS", "Lookup": "LEFT OUTER",
}
# Declared write mode and aggregate name -> what a SQL target does.
SQL_WRITE_MODES = {"APPEND": "INSERT", "OVERWRITE": "TRUNCATE_AND_INSERT", "MERGE": "UPSERT", "REPLACE": "TRUNCATE_AND_INSERT"}
SQL_AGGREGATES = ("SUM", "COUNT", "AVG", "MAX", "MIN", "STDDEV", "VARIANCE")


def sql_join_type(name: Column) -> Column:
    """Unknown and absent names mean INNER."""
    return mapped(name, SQL_JOIN_TYPES, "INNER")


def sql_write_mode(name: Column) -> Column:
    """Unknown and absent modes insert."""
    return mapped(F.upper(name), SQL_WRITE_MODES, "INSERT")


def sql_aggregate(name: Column) -> Column:
    """The SQL function of an aggregate name; NULL where SQL has none of that name here."""
    return F.when(F.upper(name).isin(*SQL_AGGREGATES), F.upper(name))


def mapped(key: Column, mapping: dict[str, str], default: Column | str) -> Column:
    """``mapping[key]``, or the default when the key is absent or NULL."""
    literal = F.create_map(*[F.lit(x) for x in chain(*mapping.items())])
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.try_element_at(literal, key), fallback)


def stage_category(stage_type: Column) -> Column:
    return mapped(stage_type, STAGE_CATEGORIES, "unknown")


def support_level(stage_type: Column) -> Column:
    return (
        F.when(stage_type.isin(*FULL_SUPPORT), "full")
        .when(stage_type.isin(*PARTIAL_SUPPORT), "partial")
        .when(stage_type.isin(*COMPLEX_SUPPORT), "complex")
        .otherwise("unknown")
    )


def column_type_columns(code: Column) -> list[Column]:
    """sql_type and spark_type of a type code."""
    return [
        mapped(code, {k: v[i] for k, v in COLUMN_TYPES.items()}, UNKNOWN_COLUMN_TYPE[i]).alias(name)
        for i, name in enumerate(("sql_type", "spark_type"))
    ]


def map_join_type(name: Column) -> Column:
    return mapped(name, JOIN_TYPES, "inner")


def map_write_mode(name: Column) -> Column:
    return mapped(F.upper(name), WRITE_MODES, "append")


def map_aggregate(name: Column) -> Column:
    return mapped(F.upper(name), AGGREGATE_NAMES, F.concat(F.lit("F."), F.lower(name)))


def map_connector(stage_type: Column) -> Column:
    return mapped(stage_type, CONNECTOR_FORMATS, "jdbc")
