"""Stages with several outputs evaluate their input once; counts come from the job's own action."""

import pytest
from pyspark.sql import functions as F

from stagecraft.operators import joins, project, quality


@pytest.fixture
def costly(spark):
    """A table whose rows are counted whenever they are computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).mapInPandas(count, "k long, v long"), seen


def test_routes_compute_the_input_once(costly):
    df, seen = costly
    out = project.route(df, {"zero": F.col("v") == 0, "one/two": F.col("v") < 3, "none": F.lit(False)})
    assert {name: (b.columns, b.count()) for name, b in out.items()} == {
        "zero": (["k", "v"], 15), "one/two": (["k", "v"], 29), "none": (["k", "v"], 0), "otherwise": (["k", "v"], 56)}
    assert seen.value == 100
    plan = out["zero"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_route" in plan


def test_halves_compute_the_input_once(costly):
    df, seen = costly
    out = project.split_rows(df, F.when(F.col("v") > 1, F.col("v") > 4))
    assert (out.main.count(), out.reject.count(), seen.value) == (28, 72, 100)


def test_both_pins_share_one_join(costly, rows, collected):
    df, seen = costly
    ref = rows([(3, "x"), (3, "y"), (7, None), (None, "n")], "k long, w string")
    out = joins.join_with_reject(df, ref, ["k"])
    assert collected(out.main) == [(3, 3, "x"), (3, 3, "y"), (7, 0, None)]
    assert out.reject.columns == ["k", "v", "_reject_reason"] and out.reject.count() == 98 and seen.value == 100
    out = joins.lookup(df, ref.where("w = 'x'"), ["k"], "Reject")
    assert (collected(out.main), out.reject.count(), seen.value) == ([(3, 3, "x")], 99, 200)


def test_pins_of_sides_with_a_common_column(rows, collected):
    out = joins.join_with_reject(rows([(1, "a"), (2, "b")], "k int, v string"), rows([(1, "c")], "k int, v string"), ["k"])
    assert (collected(out.main), collected(out.reject)) == ([(1, "a", "c")], [(2, "b", "No match on k")])


def test_counts_of_five_stages_from_one_action(spark, costly):
    df, seen = costly
    counts = quality.StageCounts()
    a = counts.watch(df, "read", odd=F.col("k") % 2 == 1)
    b = counts.watch(a.where("v > 1"), "filter")
    c = counts.watch(b.join(spark.range(50).withColumnRenamed("id", "k"), "k"), "join")
    d = counts.watch(c.groupBy("v").count(), "groups")
    counts.watch(d.where("count > 1000"), "large").write.format("noop").mode("overwrite").save()
    got = {(r.stage, r.metric): (r.n, r.ok) for r in counts.report(spark).collect()}
    joined = sum(1 for i in range(50) if i % 7 > 1)
    assert got == {("read", "rows"): (100, 1), ("read", "odd"): (50, 1), ("filter", "rows"): (70, 1), ("join", "rows"): (joined, 1),
                   ("groups", "rows"): (5, 1), ("large", "rows"): (0, 0)}
    assert seen.value == 100
    with pytest.raises(ValueError):
        counts.watch(df, "read")


def test_peek_has_a_sample(rows):
    df, seen = project.peek(rows([(i, None if i % 2 else "x") for i in range(50)], "a int, b string"), "peek-sample", {"some": F.count("b")}, sample=4)
    df.write.format("noop").mode("overwrite").save()
    counts, sample = project.peeked(seen)
    assert counts == {"rows": 50, "some": 25} and len(sample) == 4
    assert all(set(r) == {"a", "b"} and r["b"] == (None if r["a"] % 2 else "x") for r in sample)
