import re
from collections import defaultdict

import pytest

from stagecraft.llm import mixing
from stagecraft.runtime import table


def brute_targets(sizes):
    """Shares by weight, capped, the excess shared again until none is above."""
    keys = sorted(sizes, key=lambda k: (k is None, (k or "").encode("utf-32-be")))
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    total = 1.5 * sum(sizes.values())
    capped = set()
    while True:
        left = total - sum(2 * sizes[k] for k in capped)
        open_ = [k for k in keys if k not in capped]
        whole = sum(weight[k] for k in open_)
        over = [k for k in open_ if left * weight[k] / whole > 2 * sizes[k]]
        if not over:
            return {k: 2.0 * sizes[k] if k in capped else left * weight[k] / whole for k in keys}
        capped.update(over)


def brute_seats(votes, seats):
    got = {k: 0 for k in votes}
    for _ in range(seats):
        best = max((k for k in votes if votes[k] > 0), key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
        got[best] += 1
    return got


def check(docs, **kw):
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.select("doc_id", "source", "text").collect()]
    sizes = defaultdict(int)
    for _, source, n in rows:
        sizes[source] += n
    aims = brute_targets(sizes)
    joined = mixing.mix(docs, **kw).collect()
    assert sorted((r.id, r.size, r.source_size) for r in joined if r.id is not None) == sorted(
        (k, n, sizes[s]) for k, s, n in rows if k is not None)
    assert len(joined) == len(rows)
    taken = defaultdict(int)
    for r in joined:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    wanted = defaultdict(float)
    for k in sizes:
        wanted[sizes[k], round(aims[k], 6)] += aims[k]
    assert taken.keys() == {k for k in wanted}
    for k in wanted:
        assert abs(taken[k] - wanted[k]) <= 16 * len(sizes) + 16


def test_mix_meets_its_targets(spark, folder):
    check(table(spark, folder, "documents"))
    check(table(spark, folder, "documents"), shard_docs=7)


def test_odd_rows(odd_documents, no_documents):
    check(odd_documents)
    assert mixing.mix(no_documents).count() == 0
    assert mixing.mixed_documents(no_documents).count() == 0


def test_reruns_agree_at_any_partitioning(spark, folder):
    docs = table(spark, folder, "documents")
    once = sorted(tuple(r) for r in mixing.mix(docs).collect())
    assert once == sorted(tuple(r) for r in mixing.mix(docs.repartition(7)).collect())
    other = sorted(tuple(r) for r in mixing.mix(docs, seed=5).collect())
    assert [r[:4] for r in other] == [r[:4] for r in once] and other != once


@pytest.mark.parametrize("seats", [0, 1, 2, 7, 100, 1234])
@pytest.mark.parametrize("votes", [{1: 5.0}, {1: 5.0, 2: 5.0, 3: 5.0}, {1: 1000.0, 2: 1.0, 3: 0.0, 4: 37.5, 5: 37.5}, {i: float(i * i) for i in range(30)}])
def test_apportionment_by_highest_quotients(rows, votes, seats):
    df = rows([(k, v, seats) for k, v in votes.items()], "k int, v double, seats long")
    assert {r.k: r.quota for r in mixing.apportion(df, "k", "v", "seats").collect()} == brute_seats(votes, seats)


def test_no_python_in_the_plan(spark, folder):
    plan = mixing.mix(table(spark, folder, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_word_count(rows):
    texts = ["", None, " ", "a", " a\tb\n\nc ", "x y", "\x1fz", "a\x0bb\x0cc\rd"]
    df = rows([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.word_count(df.t)).collect()] == [len((t or "").encode().split()) for t in texts]


def test_mixed_documents_are_near_the_targets(spark, folder):
    docs = table(spark, folder, "documents")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    for r in mixed.select("source", "text").collect():
        got[r.source] += len(r.text.encode().split())
    longest, sizes = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        n = len(r.text.encode().split())
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    for source, aim in brute_targets(sizes).items():
        assert abs(got[source] - aim) <= longest[source] / 2 + 32
