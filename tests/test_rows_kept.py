"""Rows, columns and jobs that earlier versions lost, melted or multiplied."""

import os
from collections import Counter

import pytest
from jobxml_fixture import job, link, stage
from pyspark.sql import functions as F

from stagecraft.operators import aggregate, cells, changes
from stagecraft.operators.by_properties import aggregations, apply_stage
from stagecraft.sources import jobxml, sinks
from stagecraft.streaming import jobfiles

DIM = "k string, v int, sk long, EFF_START_DATE date, EFF_END_DATE date, IS_CURRENT_FLAG int, note string"


def test_dimension_merge_keeps_unflagged_versions_and_other_columns(rows):
    from datetime import date

    d, end = date(2024, 1, 1), date(9999, 12, 31)
    dim = rows([("a", 1, 10, d, end, 1, "x"), ("a", 0, 9, d, d, 0, "old"), ("b", 2, 11, d, end, None, "lost?"), ("c", 3, 12, d, end, 1, "same")], DIM)
    got = changes.scd2_merge(dim, rows([("a", 5), ("c", 3), ("d", 4)], "k string, v int"), ["k"], ["v"], "2024-02-01", {"sk": F.lit(-1)})
    day = date(2024, 2, 1)
    assert sorted((r.k, r.v, r.sk, r.note, r.EFF_START_DATE, r.EFF_END_DATE, r.IS_CURRENT_FLAG) for r in got.collect()) == [
        ("a", 0, 9, "old", d, d, 0), ("a", 1, 10, "x", d, day, 0), ("a", 5, -1, None, day, end, 1),
        ("b", 2, 11, "lost?", d, end, None), ("c", 3, 12, "same", d, end, 1), ("d", 4, -1, None, day, end, 1)]


def test_changes_of_a_repeated_key_are_an_error(rows):
    once, twice = rows([("a", 1)], "k string, v int"), rows([("a", 1), ("a", 2)], "k string, v int")
    for before, after in ((twice, once), (once, twice)):
        with pytest.raises(Exception, match="occurs more than once"):
            changes.change_capture(before, after, ["k"], ["v"]).collect()


@pytest.mark.parametrize("header", [True, False])
def test_merge_into_a_delimited_folder(spark, rows, tmp_path, header):
    path = str(tmp_path / "out")
    sinks.write_path(rows([(1, "a"), (2, "b"), (None, "n")], "k int, v string"), path, "overwrite", "csv", None, "|", header)
    new = sinks.write_sink(rows([(2, "B"), (None, "N"), (3, "c")], "k int, v string"), {
        "stage_type": "PxSequentialFile", "merge_keys": ["k"],
        "properties": {"File": path, "WriteMode": "Merge", "Delimiter": "|", "FirstLineIsHeader": str(header).lower()}})
    got = spark.read.schema("k int, v string").option("sep", "|").option("header", header).csv(new)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [(1, "a"), (2, "B"), (3, "c"), (None, "N")]


def export(path, text, when):
    path.write_text(text)
    os.utime(path, (when, when))


def test_the_newest_export_of_a_job_counts(spark, tmp_path):
    export(tmp_path / "z_old.dsx", job("J", [stage("A", "PxSort"), stage("GONE", "PxSort"), link(1, "A", "GONE")]).replace('"d"', '"zz"'), 1_000_000)
    export(tmp_path / "a_new.dsx", job("J", [stage("A", "PxFilter"), stage("B", "PxSort")]).replace('"d"', '"bb"'), 2_000_000)
    tables = jobxml.catalog(jobxml.read_jobs(spark, str(tmp_path)))
    assert [(r.job_id, r.description) for r in tables["jobs"].collect()] == [("J", "bb")]
    assert sorted((r.stage_id, r.stage_type) for r in tables["stages"].collect()) == [("A", "PxFilter"), ("B", "PxSort")]
    assert tables["links"].count() == 0


def test_arriving_files_broken_and_sent_again(spark, tmp_path):
    export(tmp_path / "a.dsx", job("J", [stage("A", "PxSort"), stage("GONE", "PxSort")]), 1_000_000)
    export(tmp_path / "b.dsx", job("K", [stage("X", "PxSort")]).replace("</Record>", "</Rec>", 1), 1_500_000)
    export(tmp_path / "c.dsx", job("J", [stage("A", "PxFilter")]), 2_000_000)
    out = jobfiles.ingest(spark, str(tmp_path), str(tmp_path / "catalog"), "*.dsx", files_per_batch=1)
    assert [(r.job_id, r.stage_id, r.stage_type) for r in jobfiles.current(spark, out, "stages").collect()] == [("J", "A", "PxFilter")]
    assert [r.job_id for r in jobfiles.current(spark, out, "jobs").collect()] == ["J"]
    rejects = spark.read.parquet(f"{out}/rejects").collect()
    assert [(r.file_path.rpartition("/")[2], r._reject_reason) for r in rejects] == [("b.dsx", "malformed job record")]


def test_lookups_never_multiply_rows(rows, collected):
    left, right = rows([(1, "a"), (3, "c")], "k int, l string"), rows([(1, "z"), (1, "y")], "k int, r string")
    for how, want in (("continue", [(1, "a", "y"), (3, "c", None)]), ("REJECT", [(1, "a", "y")])):
        out = apply_stage({"stage_type": "PxLookup", "properties": {"LookupKey": "k", "NoMatchHandling": how}}, left, right)
        assert collected(out.main) == want


def test_aggregations_as_exported(rows, collected):
    df = rows([("x", 1.234, "p"), ("x", 2.345, "p"), ("y", None, "q")], "g string, a double, b string")
    props = {"GroupByKeys": "g", "Aggregations": "SUM(ROUND(a, 1)) AS s, count(distinct b) as n, MAX(CASE WHEN b IN ('p', 'z') THEN a END) AS m, MIN(coalesce(b, ',)')) AS t"}
    got = apply_stage({"stage_type": "PxAggregate", "properties": props}, df).main
    assert [(g, s and round(s, 1), n, m, t) for g, s, n, m, t in collected(got)] == [("x", 3.5, 1, 2.345, "p"), ("y", None, 1, None, "q")]
    with pytest.raises(ValueError):
        aggregations("SUM(a AS b")


def test_lists_in_an_aggregation_come_in_pieces(rows, monkeypatch):
    from stagecraft.operators import by_properties

    monkeypatch.setattr(by_properties, "LIST_ROWS", 2)
    df = rows([("x", 3, "p"), ("x", 1, "q"), ("x", 2, "q"), (None, 5, "r"), ("z", None, None)], "g string, a int, b string")
    got = apply_stage({"stage_type": "PxAggregate", "properties": {
        "GroupByKeys": "g", "Aggregations": "COLLECT_LIST(a) AS l, COUNT(*) AS n, COLLECT_LIST(upper(b)) AS u"}}, df).main
    assert sorted(((r.g, r.piece, r.l, r.n, r.u) for r in got.collect()), key=repr) == sorted([
        ("x", 0, [1, 2], 3, ["P", "Q"]), ("x", 1, [3], 3, ["Q"]), (None, 0, [5], 1, ["R"]), ("z", None, None, 1, None)], key=repr)


def hot(n=600):
    """One key with most rows, half of which share one order value; small keys, a NULL key, NULL order values."""
    data = [("hot", 50 if i % 2 else i % 90, i) for i in range(n)] + [(k, i % 3, i) for k in ("a", "b", None) for i in range(7)]
    return data + [("hot", None, n + i) for i in range(40)]


def test_ranks_of_a_hot_key(rows, monkeypatch):
    data, tasks, plain = hot(), [], cells.range_cells

    def watched(*args):
        out = plain(*args)
        tasks.extend(r["count"] for r in out.groupBy(cells.RANGE).count().collect())
        return out

    monkeypatch.setattr(cells, "range_cells", watched)
    got = changes.rank_rows(rows(data, "k string, t int, id int"), ["k"], "t", "id", rows_per_cell=50).collect()
    want = []
    for key in ("hot", "a", "b", None):
        group = sorted((t is not None, t or 0, i) for k, t, i in data if k == key)
        for n, (some, t, i) in enumerate(group):
            nxt = group[n + 1] if n + 1 < len(group) else None
            want.append((key, t if some else None, i, n + 1, 1 + sum(x[:2] < (some, t) for x in group), nxt[1] if nxt and nxt[0] else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len(tasks) > 8 and max(tasks) <= 120


def test_history_of_a_hot_key(rows):
    data = [(k, i, i // 3 % 4) for k in ("hot", None) for i in range(300)] + [("a", 1, 1), ("a", 2, 1)]
    df = rows(data, "k string, d int, v int").withColumn("start", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    for size in (10, 10_000):
        kept = changes.collapse_unchanged(df, ["k"], ["start"], ["v"], rows_per_cell=size)
        assert Counter((r.k, r.d) for r in kept.collect()) == Counter([(k, i) for k in ("hot", None) for i in range(0, 300, 3)] + [("a", 1)])
        history = changes.scd2_history(df, ["k"], ["start"], rows_per_cell=size).collect()
        assert sum(r.IS_CURRENT_FLAG for r in history) == 3 and all((r.EFF_END_DATE - r.start).days == 1 for r in history if not r.IS_CURRENT_FLAG)


def test_one_value_in_most_rows_makes_many_bounded_pieces(rows):
    data = [("hot", 7)] * 500 + [("hot", i) for i in range(100)] + [("a", 1), ("a", None), (None, 2)]
    got = aggregate.collect_pieces(rows(data, "k string, v int"), ["k"], "v", 20, "vs", rows_per_cell=60).collect()
    assert all(len(r.vs) <= 20 and r.vs == sorted(r.vs) for r in got) and len(got) == 30 + 2
    assert sum((r.vs for r in sorted((r for r in got if r.k == "hot"), key=lambda r: r.piece)), []) == sorted(v for k, v in data if k == "hot")
    assert sorted((str(r.k), r.piece, r.vs) for r in got if r.k != "hot") == [("None", 0, [2]), ("a", 0, [1])]
