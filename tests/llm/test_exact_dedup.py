import hashlib
from collections import defaultdict

import numpy as np

from stagecraft.llm import exact_dedup
from stagecraft.runtime import table


def brute(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[hashlib.sha256((text or "").encode().lower()).digest()].append(key)
    return groups


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        ids = want[bytes(r.digest)]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        if r.kept:
            assert r.id == r.keep_id
            kept[bytes(r.digest)] += 1
    assert kept == {d: 1 for d in want}


def test_filter_has_no_false_negatives_and_few_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = rng.integers(0, 2**56, n, np.int64)
        made = exact_dedup.FuseFilter.from_bytes(exact_dedup.FuseFilter.build(keys).to_bytes())
        assert made.holds(keys).all()
        others = rng.integers(2**57, 2**58, 20_000, np.int64)
        assert made.holds(others).mean() < 0.02


def test_filter_takes_repeated_keys():
    made = exact_dedup.FuseFilter.build(np.array([5, 5, 7], np.int64))
    assert made.holds(np.array([5, 7], np.int64)).all()


def test_groups_equal_brute_force(spark, folder):
    check(table(spark, folder, "documents"))


def test_odd_rows(odd_documents):
    check(odd_documents)


def test_several_shards(spark, folder):
    docs = table(spark, folder, "documents")
    one = exact_dedup.exact_groups(docs).select("id", "keep_id", "group_size").collect()
    many = exact_dedup.exact_groups(docs, shard_keys=20).select("id", "keep_id", "group_size").collect()
    assert sorted(one) == sorted(many)


def test_batches_one_after_another(spark, rows):
    whole = exact_dedup.digests(rows([(i, f"t{i % 7}") for i in range(30)], "doc_id long, text string"))
    known = exact_dedup.groups_of(whole.where("id < 10"))
    for lo in (10, 20):
        known = exact_dedup.add_batch(known, exact_dedup.groups_of(whole.where(f"id >= {lo} and id < {lo + 10}")), 3)
    assert sorted((r.size, r.keep.id) for r in known.collect()) == sorted(
        (len([i for i in range(30) if i % 7 == k]), max(i for i in range(30) if i % 7 == k)) for k in range(7))


def test_empty(no_documents):
    assert exact_dedup.exact_groups(no_documents).count() == 0
    assert exact_dedup.keep_one(no_documents).count() == 0


def test_keep_one_keeps_one_row_of_each_text(odd_documents):
    kept = exact_dedup.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    texts = [(t or "").encode().lower() for (t,) in kept.select("text").collect()]
    assert sorted(texts) == sorted({(r.text or "").encode().lower() for r in odd_documents.collect()})
