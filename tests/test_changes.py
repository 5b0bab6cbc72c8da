"""Change data and dimensions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagecraft.functions import maths
from stagecraft.operators import changes, quality

OLD = ([(1, "a", 1), (2, "b", None), (3, "c", 3)], "id int, name string, v int")
NEW = ([(2, "b", None), (3, "c", 4), (4, "d", 5)], "id int, name string, v int")


def test_capture_and_apply_round_trip(rows, collected):
    old, new = rows(*OLD), rows(*NEW)
    delta = changes.change_capture(old, new, ["id"], ["name", "v"])
    assert {r["id"]: r["change"] for r in delta.collect()} == {1: "delete", 2: "unchanged", 3: "update", 4: "insert"}
    assert collected(changes.change_apply(old, delta, ["id"], ["name", "v"])) == collected(new)


def test_upsert_overwrites_with_null(rows, collected):
    got = changes.merge_upsert(rows(*OLD), rows([(1, "a", None), (9, "z", 0)], OLD[1]), ["id"])
    assert collected(got) == [(1, "a", None), (2, "b", None), (3, "c", 3), (9, "z", 0)]


def test_upsert_leaves_columns_the_update_does_not_have(rows, collected):
    got = changes.merge_upsert(rows(*OLD), rows([(1, 100)], "id int, v int"), ["id"])
    assert (1, "a", 100) in collected(got)


def test_update_without_master_is_rejected(rows, collected):
    got = changes.merge_update_reject(rows(*OLD), rows(*NEW), ["id"])
    assert collected(got) == [(4, "d", 5, "No match on id")]


def d(text):
    return dt.date.fromisoformat(text)


VERSIONS = (
    [("k", d("2024-01-01"), 1), ("k", d("2024-01-05"), 1), ("k", d("2024-03-01"), 2), ("k", d("2025-01-01"), 1), ("z", d("2024-01-01"), 9)],
    "k string, start date, v int",
)


def test_history_over_cell_borders(rows, collected):
    got = changes.scd2_history(rows(*VERSIONS), ["k"], ["start"]).where("k = 'k'").orderBy("start").collect()
    assert [str(r["EFF_END_DATE"]) for r in got] == ["2024-01-05", "2024-03-01", "2025-01-01", "9999-12-31"]
    assert [r["IS_CURRENT_FLAG"] for r in got] == [0, 0, 0, 1]


def test_collapse_keeps_a_value_that_comes_back(rows):
    got = changes.collapse_unchanged(rows(*VERSIONS), ["k"], ["start"], ["v"])
    assert [r["v"] for r in got.where("k = 'k'").orderBy("start").collect()] == [1, 2, 1]


def test_type_3(rows, collected):
    assert collected(changes.scd3(rows(*VERSIONS), ["k"], ["start"], "v")) == [("k", 1, 2), ("z", 9, None)]


DIM = "k string, v int, EFF_START_DATE date, EFF_END_DATE date, IS_CURRENT_FLAG int"


def test_type_2_load_is_idempotent(spark, rows, collected):
    dim = rows([], DIM)
    first = changes.scd2_merge(dim, rows([("a", 1), ("b", 2)], "k string, v int"), ["k"], ["v"], "2024-01-01")
    snap = rows([("a", 1), ("b", 3), ("c", None)], "k string, v int")
    second = changes.scd2_merge(first, snap, ["k"], ["v"], "2024-02-01")
    end = d("9999-12-31")
    want = sorted([
        ("a", 1, d("2024-01-01"), end, 1), ("b", 2, d("2024-01-01"), d("2024-02-01"), 0),
        ("b", 3, d("2024-02-01"), end, 1), ("c", None, d("2024-02-01"), end, 1),
    ], key=repr)
    assert collected(second) == want
    assert collected(changes.scd2_merge(second, snap, ["k"], ["v"], "2024-03-01")) == want


def test_key_that_vanishes_stays_open(rows, collected):
    first = changes.scd2_merge(rows([], DIM), rows([("a", 1)], "k string, v int"), ["k"], ["v"], "2024-01-01")
    later = changes.scd2_merge(first, rows([("b", 1)], "k string, v int"), ["k"], ["v"], "2024-02-01")
    assert [r["k"] for r in later.where("IS_CURRENT_FLAG = 1").orderBy("k").collect()] == ["a", "b"]


def test_point_in_time_is_half_open(rows):
    dim = changes.scd2_history(rows(*VERSIONS), ["k"], ["start"]).withColumnRenamed("start", "EFF_START_DATE")
    assert [r["v"] for r in changes.as_of(dim, "2024-03-01").where("k = 'k'").collect()] == [2]


def test_record_hash_changes_with_any_column(rows):
    df = changes.with_record_hash(rows([("a", "b"), ("ab", ""), ("a", None), (None, "a")], "x string, y string"), ["x", "y"])
    assert df.select("record_hash").distinct().count() == 4


def test_reconciliation(rows, collected):
    got = quality.reconcile_rows(rows(*OLD), rows(*NEW), ["id"], ["name", "v"])
    assert collected(got) == [(1, "missing", ""), (3, "changed", "v"), (4, "extra", "")]


def test_join_report_counts_fan_out_without_pairs(spark):
    left = spark.range(1000).select((F.col("id") % 2).alias("k"))
    right = spark.createDataFrame([(0,), (0,), (0,), (7,)], "k bigint")
    assert tuple(quality.join_report(left, right, ["k"]).first()) == (500, 500, 1, 1500, 3)


def test_versions_are_compared_by_value_not_by_text(rows):
    data = [(1, 1, None, "a|b", "c"), (1, 2, "", "a|b", "c"), (1, 3, "", "a", "b|c"), (1, 4, "", "a", "b|c")]
    df = rows(data, "k int, t int, x string, y string, z string")
    got = changes.collapse_unchanged(df, ["k"], ["t"], ["x", "y", "z"], cell=F.lit(0).cast("long"))
    assert sorted(r["t"] for r in got.collect()) == [1, 2, 3]
    one = changes.collapse_unchanged(rows([(1, 1, None), (1, 2, None)], "k int, t int, x string"), ["k"], ["t"], ["x"], cell=F.col("t").cast("long"))
    assert [r["t"] for r in one.collect()] == [1]


def test_null_keys_meet_and_columns_go_by_name(rows):
    dim = rows([(None, "A", "B", "2024-01-01", "9999-12-31", 1), (1, "A", "B", "2024-01-01", "9999-12-31", 1)],
               "k int, a string, b string, s string, e string, IS_CURRENT_FLAG int").select(
        "k", "a", "b", F.col("s").cast("date").alias("EFF_START_DATE"), F.col("e").cast("date").alias("EFF_END_DATE"), "IS_CURRENT_FLAG")
    snapshot = rows([("B", "A", None), ("B2", "A", 1)], "b string, a string, k int")
    once = changes.scd2_merge(dim, snapshot, ["k"], ["b", "a"], "2024-06-30")
    assert sorted((r["k"] or 0, r["a"], r["b"], r["IS_CURRENT_FLAG"]) for r in once.collect()) == [
        (0, "A", "B", 1), (1, "A", "B", 0), (1, "A", "B2", 1)]
    assert changes.scd2_merge(once, snapshot, ["k"], ["b", "a"], "2024-07-01").count() == 3
    captured = changes.change_capture(dim.where("IS_CURRENT_FLAG = 1"), snapshot, ["k"], ["a", "b"])
    assert sorted((r["k"] or 0, r["change"]) for r in captured.collect()) == [(0, "unchanged"), (1, "update")]
    applied = changes.change_apply(dim.select("k", "a", "b"), captured, ["k"], ["a", "b"])
    assert sorted((r["k"] or 0, r["b"]) for r in applied.collect()) == [(0, "B"), (1, "B2")]
    merged = changes.merge_upsert(rows([(None, "x")], "k int, v string"), rows([(None, "y")], "k int, v string"), ["k"])
    assert [tuple(r) for r in merged.collect()] == [(None, "y")]


def test_two_updates_of_one_key_are_an_error(rows):
    master, twice = rows([(1, "x")], "k int, v string"), rows([(1, "y"), (1, "z")], "k int, v string")
    with pytest.raises(Exception, match="key occurs more than once: 1"):
        changes.merge_upsert(master, twice, ["k"]).collect()


def test_a_type_2_load_shuffles_each_image_once(rows, collected):
    dim = rows([("a", 1, "2024-01-01", "9999-12-31", 1), ("a", 2, "2024-01-01", "9999-12-31", 1), (None, 3, "2024-01-01", "9999-12-31", 1),
                ("a", 0, "2023-01-01", "2024-01-01", 0)], "k string, v int, s string, e string, IS_CURRENT_FLAG int").select(
        "k", "v", F.col("s").cast("date").alias("EFF_START_DATE"), F.col("e").cast("date").alias("EFF_END_DATE"), "IS_CURRENT_FLAG")
    got = changes.scd2_merge(dim, rows([("a", 2), (None, 4), ("n", 5)], "k string, v int"), ["k"], ["v"], "2024-02-01")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(((r.k, r.v, str(r.EFF_START_DATE), r.IS_CURRENT_FLAG) for r in got.collect()), key=repr) == sorted([
        ("a", 0, "2023-01-01", 0), ("a", 1, "2024-01-01", 0), ("a", 2, "2024-02-01", 1), ("a", 2, "2024-01-01", 1),
        (None, 3, "2024-01-01", 0), (None, 4, "2024-02-01", 1), ("n", 5, "2024-02-01", 1)], key=repr)
    with pytest.raises(Exception, match="key occurs more than once: n"):
        changes.scd2_merge(dim, rows([("n", 2), ("n", 2)], "k string, v int"), ["k"], ["v"], "2024-02-01").collect()


def test_digests_are_packed_without_loss(rows):
    texts = ["ab" * 32, "AB" * 32, "abc", "", None, "00", "01", "zz", "ab\n", "é", "a" * 33]
    got = rows([(t,) for t in texts], "h string").select("h", maths.pack_digest("h").alias("p")).select("h", F.length("p").alias("n"), maths.unpack_digest("p").alias("u")).collect()
    assert [r.u for r in got] == texts and got[0].n == 33
