"""Ordered work cut into cells gives what one window per key gives."""

import random

from pyspark.sql import Window, functions as F

from stagecraft.operators import cells, changes


def skewed(spark, n=600):
    """A third of all rows has one key; some keys are NULL; times repeat."""
    rnd = random.Random(5)
    data = [
        (None if i % 17 == 0 else ("hot" if i % 3 == 0 else f"k{i % 40}"), rnd.randrange(100), i)
        for i in range(n)
    ]
    return spark.createDataFrame(data, "k string, t int, id int")


def test_numbering_equals_a_plain_window(spark):
    df = skewed(spark)
    got = cells.number_rows(df, ["k"], [F.col("t"), F.col("id")], cells.width_cells(F.col("t"), 7), "rn")
    got = cells.number_rows(got, ["k"], [F.col("t")], cells.width_cells(F.col("t"), 7), None, "rk")
    w = Window.partitionBy("k")
    want = df.withColumn("rn", F.row_number().over(w.orderBy("t", "id")).cast("long")).withColumn(
        "rk", F.rank().over(w.orderBy("t")).cast("long"))
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_neighbours_equal_lead_and_lag(spark):
    df = skewed(spark)
    cell = cells.width_cells(F.col("t"), 7)
    nxt = cells.neighbour(df, ["k"], ["t", "id"], cell, {"n_t": "t", "n_id": "id"})
    both = cells.neighbour(nxt, ["k"], ["t", "id"], cell, {"p_id": "id"}, step=-1)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("*", F.lead("t").over(w).alias("n_t"), F.lead("id").over(w).alias("n_id"), F.lag("id").over(w).alias("p_id"))
    assert sorted(map(repr, both.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_no_cell_holds_the_hot_key_whole(spark):
    df = cells.range_cells(skewed(spark, 3000), [F.col("id")], rows_per_cell=200)
    sizes = [r["count"] for r in df.groupBy("k", cells.RANGE).count().collect()]
    assert max(sizes) <= 400


def test_one_order_value_of_most_rows_is_cut_by_the_tiebreak(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(7).alias("t"), "id")
    dealt = cells.range_cells(df, [F.col("t"), F.col("id")], rows_per_cell=250)
    assert max(r["count"] for r in dealt.groupBy(cells.RANGE).count().collect()) <= 600


def test_texts_with_one_stranger_are_cut(spark):
    names = [(f"Customer#{i:09d}",) for i in range(2000)] + [("Zed",)]
    dealt = cells.range_cells(spark.createDataFrame(names, "name string"), [F.col("name")], rows_per_cell=100)
    assert max(r["count"] for r in dealt.groupBy(cells.RANGE).count().collect()) <= 300


def test_surrogate_keys_are_dense_over_many_cells(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "n")
    got = changes.surrogate_key(df, "n", start=50, rows_per_cell=10).orderBy("n").collect()
    assert [r["sk"] for r in got] == list(range(51, 51 + len(got)))


def test_surrogate_keys_of_text_with_a_shared_prefix(spark):
    names = [f"Customer#{i:09d}" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert cells.range_cells(df, [F.col("name")], 20).select(cells.RANGE).distinct().count() > 5
    got = changes.surrogate_key(df, "name", rows_per_cell=20).orderBy("name").collect()
    assert [r["sk"] for r in got] == list(range(1, 301))
    assert [r["name"] for r in got] == names


def test_positions_of_descending_keys(spark):
    from stagecraft.operators import shape

    df = spark.createDataFrame([(None if i % 7 == 0 else i // 3, i) for i in range(60)], "a int, id int")
    for keys in ("a DESC", "a ASC", "a DESC NULLS FIRST", "a ASC NULLS LAST"):
        got = shape.sort_positions(df, keys, "id", rows_per_cell=9).orderBy("position").collect()
        want = df.orderBy(*shape.sort_expressions(keys), "id").collect()
        assert [(r["position"], r["id"]) for r in got] == [(i + 1, r["id"]) for i, r in enumerate(want)]


def test_new_keys_continue_after_the_dimension(spark, rows, collected):
    dim = rows([("a", 1), ("b", 2)], "bk string, sk bigint")
    got = changes.assign_surrogate_keys(dim, rows([("b",), ("d",), ("c",), ("d",)], "bk string"), "bk")
    assert collected(got.select("bk", "sk")) == [("c", 3), ("d", 4)]
    more = changes.assign_surrogate_keys(dim, rows([("d", "y"), ("d", "x"), (None, "z")], "bk string, v string"), "bk")
    assert collected(more) == [("d", "x", 4), (None, "z", 3)]
