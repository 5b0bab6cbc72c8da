"""Stage operators on inline rows: passed and rejected, matched and unmatched, NULLs, bounds."""

import pytest
from pyspark.sql import functions as F

from stagecraft.operators import aggregate, joins, project, shape


def test_filter_halves_are_complete(rows, collected):
    df = rows([(1, 5), (2, -1), (3, None)], "id int, x int")
    out = project.filter_rows(df, F.col("x") > 0)
    assert collected(out.main) == [(1, 5)]
    assert collected(out.reject) == [(2, -1), (3, None)]


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "p"))
    out = project.filter_rows(spark.read.parquet(str(tmp_path / "p")), F.col("id") > 5)
    plan = out.main._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan


def test_route_sends_each_row_once(rows, collected):
    df = rows([(1,), (5,), (20,), (None,)], "x int")
    out = project.route(df, {"small": F.col("x") < 3, "mid": F.col("x") < 10})
    assert {k: collected(v) for k, v in out.items()} == {"small": [(1,)], "mid": [(5,)], "otherwise": [(20,), (None,)]}


def test_later_derivation_reads_an_earlier_one(rows):
    df = project.derive(rows([(10,)], "a int"), [("b", F.col("a") * 2), ("c", F.col("b") + 1)])
    assert df.first()["c"] == 21


def test_typed_cast_rejects_only_misfits(rows, collected):
    out = project.typed_cast(rows([("1", "a"), ("x", "b"), (None, "c")], "n string, s string"), [("n", "int")])
    assert collected(out.main.select("s", "n")) == [("a", 1), ("c", None)]
    assert collected(out.reject) == [("x", "b", "bad value in n")]


def test_peek_passes_rows_and_counts(rows):
    df, seen = project.peek(rows([(1,), (None,)], "x int"), "p", {"nulls": F.count(F.when(F.col("x").isNull(), 1))})
    assert len(df.collect()) == 2
    assert seen.get == {"rows": 2, "nulls": 1}


LEFT = ([(1, "a"), (2, "b"), (None, "n")], "k int, l string")
RIGHT = ([(2, "B"), (3, "C"), (None, "N")], "k int, r string")


@pytest.mark.parametrize("name, want", [
    ("Inner", [(2, "b", "B")]),
    ("LeftOuter", [(1, "a", None), (2, "b", "B"), (None, "n", None)]),
    ("RightOuter", [(2, "b", "B"), (3, None, "C"), (None, None, "N")]),
    ("FullOuter", [(1, "a", None), (2, "b", "B"), (3, None, "C"), (None, None, "N"), (None, "n", None)]),
    ("Nonsense", [(2, "b", "B")]),
])
def test_join_types(rows, collected, name, want):
    got = joins.join_stage(rows(*LEFT), rows(*RIGHT), ["k"], name).select("k", "l", "r")
    assert collected(got) == sorted(want, key=repr)


def test_full_outer_keeps_duplicates(rows, collected):
    left = rows([(1, "a"), (1, "b")], "k int, l string")
    right = rows([(1, "A"), (1, "B"), (2, "C"), (2, "C")], "k int, r string")
    ours = joins.join_stage(left, right, ["k"], "FullOuter")
    assert collected(ours) == collected(left.join(right, ["k"], "full"))


def test_join_with_reject(rows, collected):
    out = joins.join_with_reject(rows(*LEFT), rows(*RIGHT), ["k"])
    assert collected(out.main) == [(2, "b", "B")]
    assert collected(out.reject) == [(1, "a", "No match on k"), (None, "n", "No match on k")]


def test_cross(rows):
    assert joins.cross(rows(*LEFT), rows(*RIGHT).drop("k")).count() == 9


def test_lookup_modes(rows, collected):
    df, ref = rows([(1, "a"), (2, "b")], "k int, l string"), rows([(2, None)], "k int, r string")
    assert collected(joins.lookup(df, ref, ["k"], "Continue", {"r": "?"}).main) == [(1, "a", "?"), (2, "b", None)]
    assert collected(joins.lookup(df, ref, ["k"], "Drop").main) == [(2, "b", None)]
    assert collected(joins.lookup(df, ref, ["k"], "Reject").reject) == [(1, "a", "No match on k")]
    with pytest.raises(Exception, match="lookup failed on k: 1"):
        joins.lookup(df, ref, ["k"], "Fail").main.collect()
    with pytest.raises(ValueError):
        joins.lookup(df, ref, ["k"], "Guess")


def test_lookup_takes_a_join_hint(spark, rows):
    df, ref = rows([(1, "a")], "k int, l string"), rows([(1, "x"), (2, "y")], "k int, r string")

    def plan(how):
        return joins.lookup(df, ref, ["k"], how=how).main._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan("broadcast")
    assert "SortMergeJoin" in plan("merge")


def test_one_per_key(rows, collected):
    ref = rows([(1, 5, "late"), (1, 2, "early"), (2, 1, "only")], "k int, t int, v string")
    assert collected(joins.one_per_key(ref, ["k"], [F.col("t")])) == [(1, 2, "early"), (2, 1, "only")]


def test_dedup_limits_rows_before_the_shuffle(rows):
    df = rows([(1, 1)], "k int, t int")
    plan = joins.one_per_key(df, ["k"], [F.col("t")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_count_ignores_nulls_and_first_has_an_order(rows, collected):
    df = rows([("a", 2, None), ("a", 1, 7)], "k string, t int, v int")
    got = aggregate.aggregate(df, ["k"], {
        "n": F.count("v"), "first": aggregate.first_by("t", ["t"]), "last": aggregate.last_by("v", ["t"])})
    assert collected(got) == [("a", 1, 1, None)]


def test_collected_pieces_hold_everything(spark):
    df = spark.range(100).select(F.lit("hot").alias("k"), F.col("id"))
    got = aggregate.collect_pieces(df, ["k"], "id", 30, "ids").orderBy("piece").collect()
    assert [len(r["ids"]) for r in got] == [30, 30, 30, 10]
    assert sum((r["ids"] for r in got), []) == list(range(100))


def test_pivot_unpivot(rows, collected):
    df = rows([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "k string, c string, v int")
    wide = shape.pivot_rows(df, ["k"], "c", ["x", "y"], {"v": F.sum("v")})
    assert collected(wide.select("k", "x_v", "y_v")) == [("a", 1, 2), ("b", 3, None)]
    assert len(shape.unpivot_cols(wide, ["k"], ["x_v", "y_v"], "c", "v").collect()) == 4


def test_sort_expressions_keep_null_order(rows):
    df = rows([(1, "b"), (None, "a"), (2, None)], "x int, y string")
    assert [r["x"] for r in shape.sort_rows(df, "x ASC").collect()] == [None, 1, 2]
    assert [r["x"] for r in shape.sort_rows(df, "x DESC").collect()] == [2, 1, None]
    assert [r["x"] for r in shape.sort_rows(df, "x DESC NULLS FIRST").collect()] == [None, 2, 1]
    assert [r["x"] for r in shape.sort_rows(df, "x ASC NULLS LAST").collect()] == [1, 2, None]


def test_partitioning(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 10)
    parts = shape.partition_hash(df, 4, "k").withColumn("p", F.spark_partition_id())
    assert parts.groupBy("k").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    ranged = shape.partition_range(df, 4, "id").withColumn("p", F.spark_partition_id())
    ends = ranged.groupBy("p").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("lo").collect()
    assert len(ends) == 4 and all(a["hi"] < b["lo"] for a, b in zip(ends, ends[1:]))
    assert shape.partition_round_robin(df, 3).rdd.getNumPartitions() == 3
    assert shape.partition_same(df) is df
