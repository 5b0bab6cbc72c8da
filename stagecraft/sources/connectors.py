"""Source stages: one dispatcher from a stage's properties to a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stagecraft.operators.project import Branches, typed_cast

# Connector stage type -> reader format, driver class, URL or path prefix.
CONNECTORS: dict[str, tuple[str, str | None, str | None]] = {
    "PxOracleConnector": ("jdbc", "oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@"),
    "PxDB2Connector": ("jdbc", "com.ibm.db2.jcc.DB2Driver", "jdbc:db2://"),
    "PxMSSQLConnector": ("jdbc", "com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://"),
    "PxPostgresConnector": ("jdbc", "org.postgresql.Driver", "jdbc:postgresql://"),
    "PxTeradataConnector": ("jdbc", "com.teradata.jdbc.TeraDriver", "jdbc:teradata://"),
    "PxSequentialFile": ("csv", None, None),
    "PxCsvConnector": ("csv", None, None),
    "PxS3Connector": ("parquet", None, "s3a://"),
    "PxBigQueryConnector": ("bigquery", None, None),
    "PxSnowflakeConnector": ("snowflake", None, None),
}
UNKNOWN_CONNECTOR = ("jdbc", None, None)

# Column type code -> SQL type, Spark type (DDL name).
COLUMN_TYPES: dict[str, tuple[str, str]] = {
    "4": ("INTEGER", "int"), "5": ("SMALLINT", "smallint"), "-5": ("BIGINT", "bigint"),
    "8": ("FLOAT", "double"), "6": ("FLOAT", "float"),
    "2": ("NUMERIC", "decimal"), "3": ("DECIMAL", "decimal"),
    "12": ("VARCHAR", "string"), "1": ("CHAR", "string"), "-1": ("LONGVARCHAR", "string"),
    "93": ("TIMESTAMP", "timestamp"), "91": ("DATE", "date"), "92": ("TIME", "string"),
    "-2": ("BINARY", "binary"), "16": ("BOOLEAN", "boolean"),
}
UNKNOWN_COLUMN_TYPE = ("VARCHAR", "string")
DEFAULT_PRECISION, DEFAULT_SCALE = 18, 2

CORRUPT = "_corrupt_record"


def connector_options(stage_type: str) -> dict[str, str | None]:
    """Reader format, driver and URL prefix; an unknown stage type is plain jdbc."""
    fmt, driver, prefix = CONNECTORS.get(stage_type, UNKNOWN_CONNECTOR)
    return {"format": fmt, "driver": driver, "url_prefix": prefix}


def resolve(text: str, params: Mapping[str, object] | None) -> str:
    """Replace ``${NAME}``; a name without a value is an error, not an empty string."""
    def value(match: re.Match) -> str:
        if not params or match.group(1) not in params:
            raise KeyError(f"no value for parameter {match.group(1)}")
        return str(params[match.group(1)])

    return re.sub(r"\$\{([^}]+)\}", value, text)


def spark_type(code: str | None, precision=None, scale=None) -> str:
    name = COLUMN_TYPES.get(str(code), UNKNOWN_COLUMN_TYPE)[1]
    if name == "decimal":
        p = DEFAULT_PRECISION if precision is None else int(precision)
        s = DEFAULT_SCALE if scale is None else int(scale)
        return f"decimal({p},{s})"
    return name


def declared_schema(columns: list[dict]) -> T.StructType:
    """Schema of one output pin from its column definitions (name, sql_type_code, ...)."""
    schema = T.StructType()
    for c in columns:
        kind = spark_type(c.get("sql_type_code", "12"), c.get("precision"), c.get("scale"))
        schema = schema.add(c["name"], kind, c.get("nullable", True))
    return schema


def apply_declared(df: DataFrame, columns: list[dict]) -> Branches:
    """Cast text columns to their declared types; misfits, and NULLs in NOT NULL columns, go to the reject output."""
    declared = [
        (c["name"], spark_type(c.get("sql_type_code", "12"), c.get("precision"), c.get("scale")))
        for c in columns
    ]
    return typed_cast(df, declared, [c["name"] for c in columns if not c.get("nullable", True)])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = ",",
                   header: bool = True) -> Branches:
    """Delimited file with a declared schema; malformed lines go to the reject output."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    raw = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
        .option("sep", delimiter).option("header", header).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    # Spark converts only the columns it has to read, and only those can be found malformed.  The second
    # condition is always true and keeps every column in the scan, whatever is selected later.
    read = F.length(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in schema.fieldNames()])) >= 0
    bad = F.col(CORRUPT).isNotNull() & read
    main = raw.where(~bad).drop(CORRUPT)
    reject = raw.where(bad).withColumn("_reject_reason", F.lit("malformed line"))
    return Branches(main, reject)


def read_source(spark: SparkSession, stage: dict, params: Mapping[str, object] | None = None) -> DataFrame:
    """The rows of a source stage.  What a delimited file rejects is in ``read_source_with_reject``."""
    return read_source_with_reject(spark, stage, params).main


def read_source_with_reject(spark: SparkSession, stage: dict, params: Mapping[str, object] | None = None) -> Branches:
    """Read a source stage: its rows, and the lines of a delimited file that do not fit its schema.

    Sources of other kinds have no second output and give an empty one.  ``stage``: ``stage_type``, ``properties`` (as exported), optional ``schema``, and for database
    sources ``url`` and optional ``partition`` (column, lower, upper, count).
    """
    kind = connector_options(stage["stage_type"])
    props = {k: resolve(v, params) if isinstance(v, str) else v for k, v in stage.get("properties", {}).items()}
    fmt = kind["format"]
    if fmt == "csv":
        return read_delimited(
            spark, props.get("File") or props["FileName"], stage["schema"],
            props.get("Delimiter", ","), str(props.get("FirstLineIsHeader", "true")).lower() == "true",
        )
    rows = _read_typed(spark, kind, fmt, stage, props)
    return Branches(rows, rows.where(F.lit(False)).withColumn("_reject_reason", F.lit("")))


def _read_typed(spark: SparkSession, kind: dict, fmt: str, stage: dict, props: Mapping[str, str]) -> DataFrame:
    """Sources that bring their own types."""
    if fmt == "parquet":
        path = props.get("File") or props["FileName"]
        return spark.read.parquet(path if "://" in path or path.startswith("/") else kind["url_prefix"] + path)
    if fmt in ("bigquery", "snowflake"):
        name = props.get("XMLProperties.TableName") or props["TableName"]
        option = "table" if fmt == "bigquery" else "dbtable"
        return spark.read.format(fmt).options(**stage.get("options", {})).option(option, name).load()
    return spark.read.format("jdbc").options(**jdbc_options(stage, props)).load()


def jdbc_options(stage: dict, props: Mapping[str, str]) -> dict[str, str]:
    """Reader options of a database source; the exact source SQL runs in the database.

    Spark does not allow ``query`` with a partition column, so a partitioned read sends the same
    SQL as a derived table.
    """
    kind = connector_options(stage["stage_type"])
    sql = props.get("XMLProperties.SelectStatement") or props.get("SelectStatement")
    name = props.get("XMLProperties.TableName") or props.get("TableName")
    schema = props.get("XMLProperties.Schema") or props.get("Schema")
    if not sql:
        sql = f"SELECT * FROM {schema + '.' if schema else ''}{name}"
    url = stage.get("url", "")
    options = {"url": url if url.startswith("jdbc:") else (kind["url_prefix"] or "") + url,
               "fetchsize": str(stage.get("fetchsize", 10_000))}
    if kind["driver"]:
        options["driver"] = kind["driver"]
    for prop, option in (("Connection.Username", "user"), ("Connection.Password", "password")):
        if props.get(prop):
            options[option] = props[prop]
    split = stage.get("partition")
    if split:
        options |= {
            "dbtable": f"({sql}) src", "partitionColumn": split["column"],
            "lowerBound": str(split["lower"]), "upperBound": str(split["upper"]),
            "numPartitions": str(split["count"]),
        }
    else:
        options["query"] = sql
    return options


def incremental(df: DataFrame, column: str, mode: str = "full", target: DataFrame | None = None,
                window: tuple[str, str] | None = None) -> DataFrame:
    """Rows of one run: everything, those after the target's high-water mark, or a given window.

    The mark is one value and becomes a literal, so the filter reaches the scan.
    """
    if mode == "full":
        return df
    if mode == "incremental":
        mark = target.agg(F.max(column)).first()[0] if target is not None else None
        return df if mark is None else df.where(F.col(column) > F.lit(mark))
    if mode == "rerun":
        low, high = window
        return df.where((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))
    raise ValueError(f"unknown run mode: {mode}")
