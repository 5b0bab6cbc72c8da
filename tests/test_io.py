"""Source options, reads with rejects, write modes, merge and DDL."""

import os
import re

import pytest
from pyspark.sql import functions as F, types as T

from stagecraft.queries import io
from stagecraft.queries.binding import Catalog
from stagecraft.queries.registry import Tables
from stagecraft.sources import connectors, jobxml, sinks


def test_known_and_unknown_connectors():
    assert connectors.connector_options("PxDB2Connector") == {
        "format": "jdbc", "driver": "com.ibm.db2.jcc.DB2Driver", "url_prefix": "jdbc:db2://"}
    assert connectors.connector_options("Whatever") == {"format": "jdbc", "driver": None, "url_prefix": None}


def test_source_sql_is_pushed_as_query():
    stage = {"stage_type": "PxPostgresConnector", "url": "h/db"}
    props = {"XMLProperties.SelectStatement": "SELECT a FROM t WHERE b = 'X'", "Connection.Username": "u", "Connection.Password": "p"}
    got = connectors.jdbc_options(stage, props)
    assert got["query"] == "SELECT a FROM t WHERE b = 'X'" and "dbtable" not in got
    assert (got["url"], got["user"], got["driver"]) == ("jdbc:postgresql://h/db", "u", "org.postgresql.Driver")


def test_partitioned_read_keeps_the_sql():
    stage = {"stage_type": "PxOracleConnector", "url": "h:1/s", "partition": {"column": "id", "lower": 1, "upper": 9, "count": 4}}
    got = connectors.jdbc_options(stage, {"TableName": "T", "Schema": "S"})
    assert got["dbtable"] == "(SELECT * FROM S.T) src" and "query" not in got and got["numPartitions"] == "4"


def test_parameters_must_have_values():
    assert connectors.resolve("/in/${A}/${B}.csv", {"A": 1, "B": "x"}) == "/in/1/x.csv"
    with pytest.raises(KeyError):
        connectors.resolve("/in/${A}.csv", {})


def test_declared_schema_defaults():
    schema = connectors.declared_schema([
        {"name": "A", "sql_type_code": "3", "precision": None, "scale": None}, {"name": "B", "sql_type_code": "2", "precision": 10, "scale": 4},
        {"name": "C", "sql_type_code": "999"}, {"name": "D", "sql_type_code": "93", "nullable": False}])
    assert schema == T.StructType([
        T.StructField("A", T.DecimalType(18, 2)), T.StructField("B", T.DecimalType(10, 4)), T.StructField("C", T.StringType()),
        T.StructField("D", T.TimestampType(), False)])
    assert connectors.declared_schema([]) == T.StructType()


def test_malformed_lines_are_rejected(spark, tmp_path, collected):
    (tmp_path / "x.csv").write_text("id|name\n1|a\noops|b\n3|c\n")
    out = connectors.read_delimited(spark, str(tmp_path / "x.csv"), "id int, name string", "|")
    assert collected(out.main) == [(1, "a"), (3, "c")]
    assert out.reject.count() == 1 and out.reject.first()["_corrupt_record"] == "oops|b"


def test_incremental_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "s"))
    source = spark.read.parquet(str(tmp_path / "s"))
    rows = connectors.incremental(source, "id", "incremental", spark.range(50))
    assert rows.count() == 50
    assert "GreaterThan(id,49)" in rows._jdf.queryExecution().executedPlan().toString()
    assert connectors.incremental(source, "id", "incremental", spark.range(0)).count() == 100
    with pytest.raises(ValueError):
        connectors.incremental(source, "id", "sometimes")


def test_write_modes():
    assert [sinks.write_mode(m) for m in ("append", "OVERWRITE", "replace", "Merge", "?", None)] == [
        "append", "overwrite", "overwrite", "merge", "append", "append"]


def test_merge_leaves_the_old_path(spark, tmp_path, collected):
    old = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(old)
    new = sinks.merge_write(spark, old, spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string"), ["id"], str(tmp_path / "n"))
    assert collected(spark.read.parquet(new)) == [(1, "a"), (2, "B"), (3, "C")]
    assert collected(spark.read.parquet(old)) == [(1, "a"), (2, "b")]


def test_merge_into_a_catalog_table(spark, tmp_path, collected):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    spark.sql("DROP TABLE IF EXISTS merged_t")
    sinks.create_if_missing(rows, "merged_t", str(tmp_path / "m"))
    stage = {"stage_type": "PxBigQueryConnector", "properties": {"XMLProperties.TableName": "merged_t"}, "merge_keys": ["id"]}
    sinks.write_sink(rows, stage)
    stage["properties"]["XMLProperties.WriteMode"] = "MERGE"
    sinks.write_sink(spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string"), stage)
    assert collected(spark.table("merged_t")) == [(1, "a"), (2, "B"), (3, "C")]
    spark.sql("DROP TABLE merged_t")


def test_quarantine_is_partitioned_by_day(spark, tmp_path):
    path = tmp_path / "q"
    sinks.write_quarantine(spark.range(2), str(path), "2024-05-06", "no match")
    assert (path / "_reject_date=2024-05-06").is_dir()
    assert {r["_reject_reason"] for r in spark.read.parquet(str(path)).collect()} == {"no match"}


def test_sorted_files(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.write_sorted(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), path, ["k"], 4)
    rows = spark.read.parquet(path).select("k", F.input_file_name().alias("f")).groupBy("f").agg(
        F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert len(rows) == 4 and all(a["hi"] < b["lo"] for a, b in zip(rows, rows[1:]))


def test_ddl(spark):
    cols = spark.createDataFrame([
        ("s", 1, "B", "VARCHAR", 20, None, True, "it's"), ("s", 0, "A", "DECIMAL", 10, 2, False, None)],
        "sink string, ord int, name string, sql_type string, precision int, scale int, nullable boolean, comment string")
    row = sinks.ddl_statements(cols, ["sink"], F.lit("T"), F.lit("A")).first()
    assert row["ddl"] == (
        "CREATE TABLE IF NOT EXISTS T (\n  A DECIMAL(10,2) NOT NULL COMMENT '',\n  B STRING COMMENT 'it''s',\n  PRIMARY KEY (A)\n);")
    assert "_reject_reason VARCHAR(1000),\n  _reject_date DATE\n" in row["reject_ddl"] and "T_reject" in row["reject_ddl"]


def test_rows_do_not_depend_on_the_columns_read_later(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,cust,amount\n1,5,2.5\n2,bad,1.0\n3,7,3.5\n")
    got = connectors.read_delimited(spark, str(tmp_path / "in.csv"), "id int, cust int, amount double")
    assert got.main.count() == 2 and [r["id"] for r in got.main.select("id").collect()] == [1, 3]
    assert got.reject.count() == 1 and got.reject.select("_reject_reason").count() == 1
    stage = {"stage_type": "PxSequentialFile", "properties": {"File": str(tmp_path / "in.csv")}, "schema": "id int, cust int, amount double"}
    both = connectors.read_source_with_reject(spark, stage)
    assert (both.main.count(), both.reject.count()) == (2, 1)


def test_null_in_a_required_column_is_rejected(rows):
    df = rows([("1", "a"), (None, "b")], "id string, name string")
    out = connectors.apply_declared(df, [{"name": "id", "sql_type_code": "4", "nullable": False}, {"name": "name"}])
    assert [r["name"] for r in out.main.collect()] == ["a"]
    assert [r["_reject_reason"] for r in out.reject.collect()] == ["bad value in id"]


def test_delimited_sink_takes_its_properties(spark, rows, tmp_path):
    df = rows([(1, "x"), (2, "y")], "id int, name string")
    stage = {"stage_type": "PxSequentialFile", "properties": {"File": str(tmp_path / "out"), "Delimiter": "|", "FirstLineIsHeader": "false"}}
    sinks.write_sink(df.coalesce(1), stage)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1|x", "2|y"]


def test_overwrite_goes_by_column_name(spark, rows, tmp_path):
    sinks.create_if_missing(rows([("a", "b")], "a string, b string"), "by_name", str(tmp_path / "by_name"))
    stage = {"stage_type": "PxOracleConnector", "properties": {"TableName": "by_name", "WriteMode": "OVERWRITE"}}
    sinks.write_sink(rows([("B", "A")], "b string, a string"), stage)
    assert tuple(spark.table("by_name").first()) == ("A", "B")
    spark.catalog.refreshTable("by_name")
    sinks.merge_table(spark, "by_name", rows([("A", "B2")], "a string, b string"), ["a"])
    assert tuple(spark.table("by_name").first()) == ("A", "B2")
    where = spark.sql("DESCRIBE TABLE EXTENDED by_name").where("col_name = 'Location'").first()["data_type"]
    assert str(tmp_path) in where
    spark.sql("DROP TABLE by_name")


def test_broken_silent_and_unnamed_exports(spark, tmp_path):
    from stagecraft.sources import jobxml

    record = '<Record Identifier="S1" Type="PxOracleConnector"><Property name="OutputPins">1</Property></Record>'
    (tmp_path / "good.dsx").write_text(f'<DSExport><Job Identifier="J1">{record}</Job></DSExport>')
    (tmp_path / "no name.dsx").write_text(f"<DSExport><Job>{record}</Job></DSExport>")
    (tmp_path / "cut.dsx").write_text('<DSExport><Job Identifier="J2"><Record Identifier="S1" Type=')
    (tmp_path / "empty.dsx").write_text("<DSExport></DSExport>")
    both = jobxml.read_exports(spark, str(tmp_path))
    assert sorted(r["job_id"] for r in jobxml.jobs(both.main).collect()) == ["J1", "no name"]
    assert sorted(r["job_id"] for r in jobxml.catalog(jobxml.read_jobs(spark, str(tmp_path)))["stages"].collect()) == ["J1", "no name"]
    rejected = {r["file_path"].rsplit("/", 1)[1] for r in both.reject.collect()}
    assert rejected == {"cut.dsx", "empty.dsx"}


def test_a_job_in_several_elements_is_one_job(spark, tmp_path):
    from stagecraft.sources import jobxml

    (tmp_path / "a.dsx").write_text('<DSExport><Job Identifier="J" Category="c"/><Job Identifier="J" Description="d"/></DSExport>')
    got = jobxml.jobs(jobxml.read_jobs(spark, str(tmp_path))).collect()
    assert [(r["job_id"], r["description"], r["category"]) for r in got] == [("J", "d", "c")]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from stagecraft.runtime import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_a_merge_writes_only_the_files_it_touches(spark, tmp_path, collected):
    from hashlib import sha256

    path, rows = tmp_path / "with space", [(i, f"v{i}") for i in range(1000)]
    spark.createDataFrame([*rows, (None, "none")], "id int, v string").repartitionByRange(8, "id").write.parquet(str(path))

    def files():
        return {str(f): sha256(f.read_bytes()).hexdigest() for f in path.rglob("part-*.parquet")}

    before, asis = files(), collected(spark.read.parquet(str(path)))
    some = spark.createDataFrame([(5, "five"), (7, None), (None, "NULL")], "id int, v string")
    assert sinks.merge_files(spark, str(path), some, ["id"]) == 1
    assert before.items() <= files().items()
    listed = {r["path"] for r in spark.read.parquet(str(path / "_manifest" / "v=1")).collect()}
    assert len([f for f in before if "file:" + f in listed]) == len(before) - 1  # keys 5, 7 and NULL are in the first file
    want = {**dict(rows), 5: "five", 7: None, None: "NULL"}
    assert dict(collected(sinks.read_merged(spark, str(path)))) == want
    assert sinks.merge_files(spark, str(path), spark.createDataFrame([(5000, "new")], "id int, v string"), ["id"]) == 2
    assert dict(collected(sinks.read_merged(spark, str(path)))) == {**want, 5000: "new"}
    assert dict(collected(sinks.read_merged(spark, str(path), 1))) == want
    assert collected(sinks.read_merged(spark, str(path), 0)) == asis == collected(spark.read.parquet(str(path)))


def test_a_merge_of_files_refuses_partitioned_folders_and_repeated_updates(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    rows.write.partitionBy("v").parquet(str(tmp_path / "cut"))
    with pytest.raises(ValueError):
        sinks.merge_files(spark, str(tmp_path / "cut"), rows, ["id"])
    rows.write.parquet(str(tmp_path / "whole"))
    with pytest.raises(Exception, match="more than once"):
        sinks.merge_files(spark, str(tmp_path / "whole"), rows.union(rows), ["id"])
    assert sinks.merge_files(spark, str(tmp_path / "whole"), rows.limit(0), ["id"]) == 1
    assert sinks.read_merged(spark, str(tmp_path / "whole")).count() == 2


def lines(spark, folder, rows):
    """A lineitem table of (order, line, part, supplier, quantity) below ``folder``, as the catalog reads it."""
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double").selectExpr(
        "*", "'N' AS l_returnflag", "'O' AS l_linestatus").write.parquet(f"{folder}/lineitem.parquet")
    return Tables(spark, str(folder))


def test_job_files_are_compressed_and_hold_every_record(spark, tmp_path):
    """Uncompressed they filled the disk: an element is over a thousand bytes a stage."""
    t = lines(spark, tmp_path, [(o, n, o * 7 + n, o + n, float(n)) for o in range(40) for n in range(1, 5)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        path = io.write_job_files(t, 3)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    names = [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]
    assert names and all(f.endswith(".xml.gz") for f in names)
    cat = jobxml.catalog(jobxml.read_jobs(spark, path, "*.xml.gz"))
    assert cat["stages"].count() == 160 and cat["links"].count() == Catalog(t).links.count()


def test_job_files_are_made_by_several_tasks_and_equal_the_records_as_text(spark, tmp_path):
    """One task wrote them where the rows that made them were few bytes, however many elements they became."""
    t = lines(spark, tmp_path, [(o, n, o * 7 + n, o + n, float(n + o)) for o in range(40) for n in range(1, 5)])
    path = io.write_job_files(t, 3)
    assert len([f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]) > 1
    got = jobxml.catalog(jobxml.read_jobs(spark, path, "*.xml.gz"))
    parsed = io._parsed(t, jobxml.RECORD)
    for name, rows in (("columns", jobxml.columns(parsed)), ("derivations", jobxml.derivations(parsed)),
                       ("stages", parsed.drop("pos", "rec").withColumn("props", F.array_sort(F.map_entries("props"))))):
        of = got[name] if name != "stages" else got[name].withColumn("props", F.array_sort(F.map_entries("props")))
        want = rows.withColumn("job_id", F.col("job_id").cast("string"))
        assert of.count() == want.count() > 100 and not of.select(*want.columns).exceptAll(want).count()


def test_stage_records_join_and_group_nothing(spark, tmp_path):
    t = lines(spark, tmp_path, [(1, 1, 6, 11, 3.0), (1, 2, 13, 5, 2.0), (None, 1, 6, 11, 3.0)])
    cat = Catalog(t, shared=True)
    rows = io.stage_records(cat)
    plan = rows._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    held = {r["job_id"]: r["xml"] for r in rows.where("ord = 1").collect()}
    wanted = [r["name"] for r in cat.columns.where("job_id = 1 AND stage_id LIKE '%_1'").orderBy("ord").collect()]
    assert wanted and re.findall(r'"Name">(\w+)</Property><Property name="SqlType"', held[1]) == wanted
    assert "SqlType" not in held[None]
