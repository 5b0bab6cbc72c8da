"""Plans that must not grow with the tables: no second pass, no text in a shuffle, parts by size."""

import re

from stagecraft import runtime
from stagecraft.catalog import describe, gates, graph, lineage
from stagecraft.queries.binding import Catalog
from stagecraft.queries.registry import Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_both_sides_of_a_match_meet_in_one_aggregate(rows, collected):
    expected = rows([(1, "a"), (1, "b"), (1, "b"), (None, "n")], "job_id long, stage_id string")
    declared = rows([(1, "a"), (1, "a"), (1, "x"), (None, "n")], "job_id long, stage_id string")
    got = gates.match_once(expected, declared, ["job_id", "stage_id"])
    assert "Join" not in plan(got)
    assert collected(got) == sorted([
        (1, "a", 1, 2, "repeated"), (1, "b", 2, 0, "missing"), (1, "x", 0, 1, "extra"),
        (None, "n", 1, 0, "missing"), (None, "n", 0, 1, "extra")], key=repr)


def test_both_checklists_meet_in_one_aggregate(rows, collected):
    ddl = "job_id long, item string, stage_id string, detail string"
    expected = rows([(1, "join", "s", "Inner"), (1, "join", "s", "Odd"), (1, "sink", "t", None), (1, "source", "u", None),
                     (1, "computed_column", "s", "D_1"), (None, "sink", "t", None), (2, "join", "s", None)], ddl)
    declared = rows([(1, "join", "s", "Inner"), (1, "sink", "t", None), (1, "sink", "v", None), (1, "computed_column", "s", "D_2"),
                     (None, "sink", "t", None), (2, "join", "s", "Inner")], ddl)
    got = describe.structural_diff(expected, declared)
    assert "Join" not in plan(got)
    assert collected(got) == sorted([
        (1, "join", "s", "", "wrong"), (1, "sink", "t", "", "ok"), (1, "source", "u", "", "missing"), (1, "sink", "v", "", "extra"),
        (1, "computed_column", "s", "D_1", "missing"), (1, "computed_column", "s", "D_2", "extra"), (2, "join", "s", "", "wrong"),
        (None, "sink", "t", "", "missing"), (None, "sink", "t", "", "extra")], key=repr)


def test_properties_are_read_before_the_join_of_hints(rows):
    stages = rows([(1, "s", "PxLookup", {"Notes": "Slowly Changing load"})], "job_id long, stage_id string, stage_type string, props map<string,string>")
    derivations = rows([(1, "s", "Checksum(ID)")], "job_id long, stage_id string, expression string")
    got = describe.complexity_hints(stages, derivations)
    joined = re.search(r"Join LeftOuter.*", plan(got), re.S).group()
    assert "concat_ws" in joined and sorted(r.hint for r in got.collect()) == ["hash_computation", "lookup_join", "scd_type2"]


def test_no_expression_reaches_a_join_of_edges(rows, collected):
    columns = rows([(1, "a", "ID"), (1, "b", "ID"), (1, "b", "X")], "job_id long, stage_id string, name string")
    derivations = rows([(1, "b", "X", "Trim(ID)"), (1, "b", "Y", "ID")], "job_id long, stage_id string, output_column string, expression string")
    stages = rows([(1, "a", "source"), (1, "b", "transformer")], "job_id long, stage_id string, category string")
    got = lineage.edges(columns, derivations, stages, rows([(1, "a", "b")], "job_id long, from_stage string, to_stage string"))
    assert [(r.column_name, r.edge_type, float(r.confidence)) for r in got.orderBy("column_name").collect()] == [
        ("ID", "PassThrough", 1.0), ("X", "Derivation", 0.95), ("Y", "Rename", 1.0)]
    above = plan(got).splitlines()
    last = max(i for i, line in enumerate(above) if "Join" in line)
    assert not [line for line in above[:last] if re.search(r"(Project|Aggregate).*\bexpression#", line) and "Generate" not in line and "AS own" not in line]


def test_trimming_leaves_what_lies_on_or_between_cycles(rows, collected):
    edges = rows([(1, a, b) for a, b in ["ab", "bc", "cb", "cd", "de", "ef", "fe", "fg", "gh"]] + [(2, "a", "b")],
                 "job_id long, from_stage string, to_stage string")
    left, n = graph.trimmed(edges)
    assert n == 6 and collected(left.select("job_id", "from_stage", "to_stage")) == sorted([(1, *x) for x in ["bc", "cb", "cd", "de", "ef", "fe"]], key=repr)


def test_a_shared_catalog_stores_numbers_and_no_texts(spark):
    cat = Catalog(Tables(runtime.tune(spark), FOLDER), shared=True)
    assert cat.base.inputFiles() and "parquet" in cat.base.inputFiles()[0] and "lineitem" not in cat.base.inputFiles()[0]
    assert not [k for _, k in cat.base.dtypes if k not in ("bigint", "int")]
    assert cat.staged.inputFiles() == cat.links.inputFiles() == cat.base.inputFiles()


def test_shuffles_start_with_parts_by_the_size_of_the_table(spark, monkeypatch):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    runtime.spread(spark, FOLDER, "lineitem")
    least = int(spark.conf.get(name))
    monkeypatch.setattr(runtime, "PART_BYTES", 1 << 10)
    runtime.spread(spark, FOLDER, "lineitem")
    assert least == int(spark.conf.get("spark.sql.shuffle.partitions")) < int(spark.conf.get(name))
