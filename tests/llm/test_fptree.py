import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stagecraft.llm import fptree
from stagecraft.runtime import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """(item id, rank, doc id, score), scoring every document for every item."""
    bags = [(key, Counter(found(text)), len(found(text))) for key, text in docs]
    total, length = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df, out = Counter(t for _, bag, _ in bags for t in bag), []
    for item, text in items:
        scores = []
        for row, (key, bag, n) in enumerate(bags):
            score = 0
            for t in set(found(text)) & bag.keys():
                m = 50 + 50 * n * total // length
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0:
                scores.append((-score, key is None, key or 0, row))
        out += [(item, i + 1, None if none else key, -s) for i, (s, none, key, _) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def check(docs, items, k=50):
    got = fptree.ranked_search(docs, items, k=k)
    rows = lambda df: [tuple(r) for r in df.collect()]
    want = brute(rows(docs.select("doc_id", "text")), rows(items.select("item_id", "text")), k)
    assert sorted((tuple(r)[1:] for r in got.collect()), key=repr) == want
    return want


def test_documents(spark, folder):
    assert len(check(table(spark, folder, "documents"), table(spark, folder, "benchmark"))) > 100


@pytest.mark.parametrize("k", [1, 7])
def test_many_small_trees_leaves_and_blocks(spark, folder, monkeypatch, k):
    for name, n in (("TREE_DOCS", 23), ("LEAF", 3), ("BLOCK_TERMS", 300), ("SEED", 3)):
        monkeypatch.setattr(fptree, name, n)
    check(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k)


def test_odd_documents_and_items(spark, odd_documents, no_documents, rows):
    items = rows([(1, "same TEXT one ÜBER über"), (2, None), (2, "another two"), (2, "another two"), (None, "w5 7 x"), (3, "\x00 --- _"), (4, "w1 " * 9000)],
                 "item_id long, text string")
    check(odd_documents, items, 5)
    check(no_documents, items)
    check(odd_documents, items.where("item_id = 3"))
    check(odd_documents, items.where("item_id > 100"))


def test_ties_and_equal_documents(rows):
    docs = rows([(i % 150, "tie here" if i % 3 else "tie here again") for i in range(400)], "doc_id long, text string")
    check(docs, rows([(0, "tie"), (1, "here again"), (2, "none")], "item_id long, text string"), 60)


def test_bounds_hold_and_prune():
    rng = random.Random(2)
    docs = []
    for _ in range(3000):
        terms = sorted({min(int(rng.paretovariate(0.5)), 400) - 1 for _ in range(rng.randrange(1, 40))})
        docs.append((terms, [rng.randrange(1, 5) for _ in terms], rng.randrange(50, 200)))
    docs.sort(key=lambda d: d[0])
    starts = np.concatenate([[0], np.cumsum([len(d[0]) for d in docs])])
    tree = fptree.Tree(np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs]), starts, np.array([d[2] for d in docs]))
    keys = np.stack([np.zeros(3000, np.int64), np.arange(3000), np.arange(3000)], axis=1)
    looked = 0
    for _ in range(30):
        terms = np.array(sorted(rng.sample(range(20, 400), 12)))
        dense = np.zeros(400, np.int64)
        dense[terms] = 2000 + 40 * terms
        all_scores = np.add.reduceat(dense[tree.path] * tree.score, starts[:-1])
        best = fptree.Best(10, 0)
        best.keys = keys
        seen, offer = [], best.offer
        best.offer = lambda s, d: (seen.append(len(d)), offer(s, d))
        tree.search(terms, dense, best)
        order = [i for i in np.lexsort((np.arange(3000), -all_scores))[:10] if all_scores[i] > 0]
        assert best.score.tolist() == all_scores[order].tolist() and best.key[:, 1].tolist() == order
        looked += sum(seen)
    assert looked < 30 * 3000 / 3
