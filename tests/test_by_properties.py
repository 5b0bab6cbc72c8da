"""Stages driven by exported properties."""

import pytest

from stagecraft.operators.by_properties import apply_stage, measures


def run(kind, props, *inputs):
    return apply_stage({"stage_type": kind, "properties": props}, *inputs)


def test_filter(rows, collected):
    out = run("PxFilter", {"FilterCondition": "a > 1 AND b IS NOT NULL"}, rows([(1, "x"), (2, None), (3, "y")], "a int, b string"))
    assert (collected(out.main), out.reject.count()) == ([(3, "y")], 2)
    assert run("PxFilter", {}, rows([(1,)], "a int")).main.count() == 1


def test_joins_and_lookups(rows, collected):
    left, right = rows([(1, "a"), (2, "b")], "k int, l string"), rows([(2, "B")], "k int, r string")
    out = run("PxJoin", {"JoinType": "Inner", "JoinKey": " k "}, left, right)
    assert (collected(out.main), out.reject.count()) == ([(2, "b", "B")], 1)
    assert run("PxJoin", {"JoinType": "LeftOuter", "JoinKey": "k"}, left, right).main.count() == 2
    assert run("PxLookup", {"LookupKey": "k"}, left, right).main.count() == 2
    assert run("PxLookup", {"LookupKey": "k", "NoMatchHandling": "Drop"}, left, right).main.count() == 1


def test_aggregate_and_sort(rows, collected):
    df = rows([("x", 1, 5), ("x", 2, 4), ("y", 3, None)], "g string, t int, v int")
    props = {"GroupByKeys": "g", "Aggregations": "sum(v) AS total, COUNT(*) as n,FIRST(v) AS f, LAST(v) AS l", "SortKeys": "t ASC"}
    assert collected(run("PxAggregate", props, df).main) == [("x", 9, 2, 5, 4), ("y", None, 1, None, None)]
    assert [r["t"] for r in run("PxSort", {"SortKeys": "g DESC, t"}, df).main.collect()] == [3, 1, 2]


def test_what_cannot_be_read_is_an_error(rows):
    for text in ("SUM(a)", "NOPE(a) AS b", "FIRST(a) AS b"):
        with pytest.raises(ValueError):
            measures(text)
    with pytest.raises(ValueError):
        run("PxNothing", {}, rows([(1,)], "a int"))
