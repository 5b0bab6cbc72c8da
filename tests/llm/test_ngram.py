import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stagecraft.llm import ngram
from stagecraft.llm.eliasfano import EliasFano
from stagecraft.llm.util import id_crc
from stagecraft.runtime import table


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=200), st.integers(0, 100))
def test_elias_fano_holds_any_rising_sequence(values, more):
    values = np.array(sorted(values), np.int64)
    seq = EliasFano(iter(EliasFano.encode(values, 5001 + more)))
    assert seq.access(np.arange(len(values))).tolist() == values.tolist()
    ask = np.arange(5001)
    whole = np.zeros(len(ask), np.int64)
    got = seq.find(ask, whole, whole + len(values))
    first = np.searchsorted(values, ask)
    assert got.tolist() == [int(i) if i < len(values) and values[i] == x else -1 for i, x in zip(first, ask)]


def brute(rows, held):
    tokens = [((t or "").encode().lower().split() + [b""]) for _, t in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(key, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
            for (key, _), h, t in zip(rows, held, tokens)]


def check(docs, **kw):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    held = [zlib.crc32(b"" if k is None else str(k).encode()) % 10 == 0 for k, _ in rows]
    got = ngram.score_documents(docs, id_crc("doc_id") % 10 == 0, **kw).collect()
    have = sorted(((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr)
    assert have == sorted(((*x[:5], round(x[5], 6)) for x in brute(rows, held)), key=repr)
    assert all(r.score <= 0 for r in got)
    return got


def test_base_scores_and_better_held_out_scores(spark, folder):
    got = [r for r in check(table(spark, folder, "documents")) if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_a_small_head_gives_the_same_base_scores(spark, folder):
    check(table(spark, folder, "documents"), vocabulary=20, hot=50, kept=100)


def test_odd_rows(odd_documents, no_documents, spark):
    check(odd_documents)
    assert ngram.score_documents(no_documents, F.lit(False)).count() == 0
    unknown = ngram.score_documents(odd_documents, F.lit(True)).collect()
    assert {r.n_known for r in unknown} == {0} and {r.train_tokens for r in unknown} == {0}


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(4)
    size = 6
    text = rng.choice(size, 3000, p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05])
    text[10:2000:3] = (text[9:1999:3] + 1) % size
    pair, triple = Counter(zip(text, text[1:])), Counter(zip(text, text[1:], text[2:]))
    n = np.bincount(text, minlength=size).astype(float)
    log_p1 = np.log10((n + 0.1) / (n.sum() + 0.1 * (size + 1)))
    p = sorted((u * size + v, c) for (u, v), c in pair.items() if c >= 2)
    t = sorted(((u * size + v) * size + w, c) for (u, v, w), c in triple.items() if c >= 2)
    split = lambda x: (np.array([a for a, _ in x]), np.array([b for _, b in x], float))
    trie = ngram.Trie.mapped(ngram.Trie.build(size, log_p1, *split(p), *split(t), n, split(p)[1], (0.7, 0.8)))
    return size, log_p1, dict(p), dict(t), n, trie


def test_trie_gives_the_discounted_probabilities(small):
    size, log_p1, pairs, triples, n, trie = small
    p1 = 10 ** log_p1

    def p2(v, w):
        rest = 1 - sum((pairs[v * size + x] - 0.7) / n[v] for x in range(size) if v * size + x in pairs)
        return (pairs.get(v * size + w, 0.7) - 0.7) / n[v] + rest * p1[w]

    def p3(u, v, w):
        key = u * size + v
        if key not in pairs:
            return p2(v, w)
        rest = 1 - sum((triples[key * size + x] - 0.8) / pairs[key] for x in range(size) if key * size + x in triples)
        return (triples.get(key * size + w, 0.8) - 0.8) / pairs[key] + rest * p2(v, w)

    u, v, w = (x.ravel() for x in np.meshgrid(range(size), range(size), range(size), indexing="ij"))
    got = trie.log_p(u, v, w, log_p1[w])
    want = np.log10([p3(*x) for x in zip(u, v, w)])
    assert np.abs(got - want).max() < 0.05 and np.abs(got - want).mean() < 0.01


def test_probabilities_after_a_context_sum_to_one(small):
    size, log_p1, *_, trie = small
    seen = np.arange(size)
    unknown = np.log10(1 - (10 ** log_p1).sum())
    for u in range(-1, size):
        for v in range(-1, size):
            p = 10 ** trie.log_p(np.full(size + 1, u), np.full(size + 1, v), np.append(seen, -1), np.append(log_p1, unknown))
            assert abs(p.sum() - 1) < 0.02


@pytest.mark.parametrize("sizes", [{}, {"vocabulary": 3, "hot": 8, "kept": 400}, {"vocabulary": 0, "hot": 0, "kept": 150}])
def test_scores_come_from_all_ngrams_of_all_words(spark, sizes):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in 1.3 ** rng.integers(0, 16, rng.integers(0, 60))) for _ in range(40)]
    texts += [*texts[:10], "only here", "only here again", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: r for r in ngram.score_documents(docs, id_crc("doc_id") % 10 == 0, **sizes).collect()}

    streams = {k: ["<", "", *(t or "").split(), ""] for k, t in enumerate(texts)}
    triples = {k: list(zip(s, s[1:], s[2:])) for k, s in streams.items()}
    train = [t for k, ts in triples.items() if not got[k].held_out for t in ts]
    ones, twos, threes = Counter(w for _, _, w in train), Counter((v, w) for _, v, w in train), Counter(train)
    spans, follows = Counter((u, v) for u, v, _ in train), Counter(v for _, v, _ in train)
    # The codes, parts and shards that say which trigrams share a discount.
    total, hot, kept = len(train), sizes.get("hot", 1 << 17), sizes.get("kept", 1_250_000)
    shards = max(1, -(-total // kept))
    cut = ngram._cutoff(spark.createDataFrame([(w, n) for w, n in ones.items()], "w string, n long"), hot)
    head = sorted((w for w in ones if ones[w] >= cut), key=lambda w: (-ones[w], w.encode()))
    rank = ngram.Codes({w.encode(): i for i, w in enumerate(head)})
    parts = np.minimum([-(-ones[w] // (kept // 2)) for w in head[:sizes.get("vocabulary", 8192)]], shards).astype(np.int64)
    code = lambda w: ngram.START if w == "<" else rank[w.encode()]
    place = lambda u, v: (v, int(ngram.shard_of(np.array([code(u)]), np.array([code(v)]), parts, shards)[0]))
    assert bool((parts > 1).any()) == (sizes.get("vocabulary") == 3)

    def discount(counts):
        one, two = counts.count(1), counts.count(2)
        return min(0.95, max(0.1, one / (one + 2 * two))) if one + two else 0.5

    by2, by3 = {}, {}
    for (v, w), n in twos.items():
        by2.setdefault(v, {})[w] = n
    for (u, v, w), n in threes.items():
        by3.setdefault(place(u, v), []).append(n)
    next3 = {}
    for (u, v, w), n in threes.items():
        next3.setdefault((u, v), {})[w] = n
    p1 = lambda w: (ones[w] + 0.1) / (total + 0.1 * (len(ones) + 1))

    def p2(v, w):
        found = by2.get(v, {})
        d = discount(list(found.values()))
        return max(found.get(w, 0) - d, 0) / max(1, follows[v]) + (d * len(found) / follows[v] if found else 1) * p1(w)

    def p3(u, v, w):
        found = next3.get((u, v), {})
        if not found:
            return p2(v, w)
        d = discount(by3[place(u, v)])
        return max(found.get(w, 0) - d, 0) / spans[u, v] + d * len(found) / spans[u, v] * p2(v, w)

    # Probabilities are 256 quantile means a level.
    off = [abs(got[k].score - sum(math.log10(p3(*t)) for t in ts)) / len(ts) for k, ts in triples.items()]
    assert len(got) == len(off) == len(texts) and max(off) < 0.05 and np.mean(off) < 0.01
