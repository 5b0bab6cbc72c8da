import numpy as np
import pytest
from pyspark.sql import functions as F

from stagecraft.llm import topk
from stagecraft.runtime import table


def brute(rows, k):
    kept = [(i, np.floor(np.asarray(v, float) * 64).astype(object)) for i, v in rows
            if v is not None and None not in v and np.isfinite(np.asarray(v, float)).all()]
    out = []
    for a, (qi, q) in enumerate(kept):
        if qi is None or qi % 20:
            continue
        scores = [(-int((q * c).sum()), i is None, i or 0) for b, (i, c) in enumerate(kept) if b != a and len(c) == len(q)]
        out += [(qi, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def check(df, k=20):
    rows = [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()]
    got = topk.exact_top_k(df, F.col("id") % 20 == 0, k=k).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, k)


def test_equals_brute_force(spark, folder):
    check(table(spark, folder, "embeddings"))


def test_many_small_stripes_and_chunks(spark, folder, monkeypatch):
    for name, n in (("STRIPE", 70), ("CHUNK", 9), ("BLOCK", 16), ("QUERY_BLOCK", 4)):
        monkeypatch.setattr(topk, name, n)
    check(table(spark, folder, "embeddings"), k=3)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.5, -1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (None, None), (40, []), (5, []), (60, [1.0, 2.0, 3.0]), (7, [-0.0, 0.001]), (8, [1e6, -1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "score": F.lit(2), "row": F.lit(3)})
    check(df)
    check(df.where("vec_id > 1000"))


def test_ties_go_to_the_smaller_id(spark):
    check(spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(200)], "vec_id long, embedding array<double>"))


def test_pruning_keeps_every_best_candidate():
    rng = np.random.default_rng(2)
    c = (rng.normal(size=(5000, 24)) * rng.pareto(1.5, (5000, 1)) * 100 * 0.7 ** np.arange(24)).astype(np.int64)
    q = c[:50]
    i, j, s = topk.search(c, np.arange(5000), np.arange(5000), q, np.arange(50), 10)
    want = q @ c.T
    want[np.arange(50), np.arange(50)] = -(2**60)
    for a in range(50):
        order = np.lexsort((np.arange(5000), -want[a]))[:10]
        assert j[i == a].tolist() == order.tolist() and s[i == a].tolist() == want[a][order].tolist()


def test_too_large_scores_raise():
    with pytest.raises(OverflowError):
        topk.search(np.array([[2**40]]), np.array([1]), np.array([1]), np.array([[2**40]]), np.array([0]), 1)
