"""Target stages: write modes, merge, quarantine, sorted writes and DDL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stagecraft.operators.changes import merge_upsert
from stagecraft.runtime import store
from stagecraft.sources.connectors import connector_options, resolve

# Declared write mode -> Spark mode.
WRITE_MODES = {"APPEND": "append", "OVERWRITE": "overwrite", "MERGE": "merge", "REPLACE": "overwrite"}


def write_mode(name: str | None) -> str:
    """Unknown and absent modes append."""
    return WRITE_MODES.get((name or "").upper(), "append")


def write_path(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet",
               partition_by: list[str] | None = None, delimiter: str = ",", header: bool = True) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", header).option("sep", delimiter)
    if partition_by:
        # Only the partitions present in the data are replaced.
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def merge_write(spark: SparkSession, target: str, updates: DataFrame, keys: list[str],
                out: str | None = None, fmt: str = "parquet", delimiter: str = ",", header: bool = True) -> str:
    """Upsert into a folder: the merged image is written beside it in the same format, the new path returned.

    A delimited folder is read by the updates' column names and types, in their order.  Readers of the old path are never
    disturbed, and a lost write leaves it untouched.
    """
    out = out or _beside(target)
    if fmt == "csv":
        master = spark.read.schema(updates.schema).option("header", header).option("sep", delimiter).option("enforceSchema", not header).csv(target)
    else:
        master = spark.read.format(fmt).load(target)
    write_path(merge_upsert(master, updates, keys), out, "errorifexists", fmt, None, delimiter, header)
    return out


def _beside(path: str) -> str:
    """A new folder next to a path, in the same store."""
    return f"{path.rstrip('/')}-merged-{uuid.uuid4().hex}"


MANIFEST, VERSION = "_manifest", "v="


def _plain(paths: Iterable[str]) -> list[str]:
    """File names without URL escapes and an empty authority, so that names from different sources agree."""
    return [re.sub(r"^(\w+):/{3}(?=[^/])", r"\1:/", unquote(p)) for p in paths]


def _current(spark: SparkSession, target: str) -> tuple[int, list[str]]:
    """Number of the newest complete manifest (0: none yet) and the files that make up the table."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/{MANIFEST}/{VERSION}*/_SUCCESS")
    store_of = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [f.getPath().getParent().getName() for f in store_of.globStatus(place) or []]
    version = max((int(name.removeprefix(VERSION)) for name in done), default=0)
    if version:
        rows = spark.read.parquet(f"{target}/{MANIFEST}/{VERSION}{version}").collect()
        return version, [r["path"] for r in rows]
    return 0, _plain(spark.read.parquet(target).inputFiles())


def read_merged(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """A folder as its newest manifest has it, or an earlier one; without a manifest, the whole folder."""
    if version is None:
        version, files = _current(spark, target)
    elif version:
        files = [r["path"] for r in spark.read.parquet(f"{target}/{MANIFEST}/{VERSION}{version}").collect()]
    return spark.read.parquet(*files) if version else spark.read.parquet(target)


def merge_files(spark: SparkSession, target: str, updates: DataFrame, keys: list[str]) -> int:
    """Upsert into a Parquet folder that writes only the files holding an updated key, and new keys; returns the version.

    One scan of the key columns names these files.  Their merged rows go to new files below the target, and a manifest
    lists them with all others, which stay as they are.  ``read_merged`` follows the newest manifest; plain readers of
    the folder go on seeing what it held before.  The manifest is written last, so a lost merge changes nothing, and of
    two merges that began at one version the second fails.  The driver handles file names, as any Spark reader does, but
    no rows.  Folders that are partitioned by column values are refused.
    """
    version, files = _current(spark, target)
    if any("=" in f.removesuffix(f.rpartition("/")[2]).rpartition(target.rstrip("/"))[2] for f in files):
        raise ValueError(f"{target} is partitioned by column values")
    given = store(updates, "updates")
    master = spark.read.parquet(*files) if version else spark.read.parquet(target)
    names = [f"_key_{i}" for i in range(len(keys))]
    wanted = given.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    found = master.select(*keys, F.col("_metadata.file_path").alias("_file")).join(wanted, same, "left_semi")
    touched = set(_plain(r["_file"] for r in found.select("_file").distinct().collect()))
    if not touched <= set(files):
        raise RuntimeError(f"files of {target} that its manifest does not list: {sorted(touched - set(files))[:3]}")
    held = spark.read.schema(master.schema).parquet(*sorted(touched)) if touched else spark.createDataFrame([], master.schema)
    out = f"{target.rstrip('/')}/_merged/{uuid.uuid4().hex}"
    merge_upsert(held, given, keys).select(*master.columns).write.parquet(out)
    new = _plain(spark.read.schema(master.schema).parquet(out).inputFiles())
    listed = spark.createDataFrame([(f,) for f in [*(f for f in files if f not in touched), *new]], "path string")
    listed.coalesce(1).write.mode("errorifexists").parquet(f"{target}/{MANIFEST}/{VERSION}{version + 1}")
    return version + 1


def merge_table(spark: SparkSession, name: str, updates: DataFrame, keys: list[str],
                row_level: bool = False) -> None:
    """Upsert into a catalog table.

    ``row_level``: the table's format has MERGE (Spark's ``mergeInto``).  Otherwise the merged image
    is written beside the table, into its own store, and the table's location is switched to it.
    """
    if row_level:
        on = None
        for k in keys:
            same = F.expr(f"source.`{k}` <=> {name}.`{k}`")  # NULL keys meet, as in the merge that is written beside
            on = same if on is None else on & same
        updates.alias("source").mergeInto(name, on).whenMatched().updateAll().whenNotMatched().insertAll().merge()
        return
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'")
    out = _beside(described.first()["data_type"])
    merge_upsert(spark.table(name), updates, keys).write.parquet(out)
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{out}'")
    spark.catalog.refreshTable(name)


def create_if_missing(df: DataFrame, name: str, path: str | None = None) -> None:
    """CreateTableIfNotExists: an empty table with the frame's schema."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        writer = df.limit(0).write.format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(name)


def write_sink(df: DataFrame, stage: dict, params: Mapping[str, object] | None = None) -> str | None:
    """Write a target stage (``stage_type``, ``properties``; ``table``/``path``/``merge_keys``)."""
    props = {k: resolve(v, params) if isinstance(v, str) else v for k, v in stage.get("properties", {}).items()}
    mode = write_mode(props.get("XMLProperties.WriteMode") or props.get("WriteMode"))
    spark = df.sparkSession
    path = props.get("File") or props.get("FileName") or stage.get("path")
    if path:
        fmt = "csv" if connector_options(stage["stage_type"])["format"] == "csv" else "parquet"
        delimiter, header = props.get("Delimiter", ","), str(props.get("FirstLineIsHeader", "true")).lower() == "true"
        if mode == "merge":
            return merge_write(spark, path, df, stage["merge_keys"], None, fmt, delimiter, header)
        write_path(df, path, mode, fmt, stage.get("partition_by"), delimiter, header)
        return path
    name = props.get("XMLProperties.TableName") or props["TableName"]
    if str(props.get("XMLProperties.CreateTableIfNotExists", "false")).lower() == "true":
        create_if_missing(df, name)
    if mode == "merge":
        merge_table(spark, name, df, stage["merge_keys"])
    else:  # insertInto goes by position
        df.select(*spark.table(name).columns).write.insertInto(name, overwrite=mode == "overwrite")
    return None


def quarantine(df: DataFrame, run_date: str, reason: str | Column | None = None) -> DataFrame:
    """Reject rows with ``_reject_reason`` and ``_reject_date`` (the run date, a parameter)."""
    if reason is not None:
        df = df.withColumn("_reject_reason", F.lit(reason) if isinstance(reason, str) else reason)
    return df.withColumn("_reject_date", F.lit(run_date).cast("date"))


def write_quarantine(df: DataFrame, path: str, run_date: str, reason: str | Column | None = None) -> None:
    quarantine(df, run_date, reason).write.mode("append").partitionBy("_reject_date").parquet(path)


def write_sorted(df: DataFrame, path: str, keys: list[str], partitions: int | None = None,
                 mode: str = "overwrite") -> None:
    """Files in key order: range partitions, sorted inside, never one task."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def ddl_statements(columns: DataFrame, table_keys: list[str], table_name: Column,
                   merge_keys: Column | None = None) -> DataFrame:
    """Two CREATE TABLE statements per sink: the table and its reject twin.

    ``columns``: the table keys plus ord, name, sql_type, precision, scale, nullable, comment.  A
    table's column count is bounded, so one string per table is safe.
    """
    is_number = F.col("sql_type").isin("NUMERIC", "DECIMAL")
    kind = (
        F.when(is_number & F.col("precision").isNotNull(),
               F.format_string("DECIMAL(%d,%d)", F.col("precision"), F.coalesce(F.col("scale"), F.lit(0))))
        .when(F.col("sql_type").isin("VARCHAR", "CHAR") & F.col("precision").isNotNull(), F.lit("STRING"))
        .otherwise(F.col("sql_type"))
    )
    line = F.concat(
        F.lit("  "), F.col("name"), F.lit(" "), kind,
        F.when(F.col("nullable"), "").otherwise(" NOT NULL"),
        F.concat(F.lit(" COMMENT '"), F.replace(F.coalesce(F.col("comment"), F.lit("")), F.lit("'"), F.lit("''")), F.lit("'")),
    )
    grouped = columns.withColumn("_table", table_name).withColumn("_line", line)
    if merge_keys is not None:
        grouped = grouped.withColumn("_pk", merge_keys)
    else:
        grouped = grouped.withColumn("_pk", F.lit(None).cast("string"))
    body = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "_line"))), lambda x: x["_line"]), ",\n"
    )
    tables = grouped.groupBy(*table_keys, "_table").agg(body.alias("_body"), F.max("_pk").alias("_pk"))
    head = F.lit("CREATE TABLE IF NOT EXISTS ")
    return tables.select(
        *table_keys,
        F.concat(head, F.col("_table"), F.lit(" (\n"), F.col("_body"),
                 F.when(F.col("_pk").isNull(), "").otherwise(F.concat(F.lit(",\n  PRIMARY KEY ("), F.col("_pk"), F.lit(")"))),
                 F.lit("\n);")).alias("ddl"),
        F.concat(head, F.col("_table"), F.lit("_reject (\n"), F.col("_body"),
                 F.lit(",\n  _reject_reason VARCHAR(1000),\n  _reject_date DATE\n);")).alias("reject_ddl"),
    )
