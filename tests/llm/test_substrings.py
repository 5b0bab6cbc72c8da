import random
from collections import Counter

import numpy as np
import pytest

from stagecraft.llm import substrings
from stagecraft.llm.fmindex import FMIndex, suffix_order
from stagecraft.runtime import table


def brute(rows, length):
    tokens = [(key, (text or "").encode().split()) for key, text in rows]
    seen = Counter(tuple(t[i:i + length]) for _, t in tokens for i in range(len(t) - length + 1))
    out = []
    for key, t in tokens:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[tuple(t[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        out.append((key, len(t), sum(gone), b" ".join(w for w, g in zip(t, gone) if not g).decode()))
    return Counter(out)


def check(docs, length=35):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = Counter((r.id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, length=length).collect())
    assert got == brute(rows, length)


def tangled(seed, n=60):
    """Texts that share passages of many lengths, repeat themselves, and meet in few words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
        if i % 7 == 0:
            text += ["be"] * rng.randint(1, 90)
        rows.append((i, "\n ".join(text)))
    return rows


def test_equals_brute_force(spark, folder):
    check(table(spark, folder, "documents"))


@pytest.mark.parametrize("length", [8, 12, 35])
def test_tangled_texts(rows, length):
    check(rows(tangled(length), "doc_id long, text string"), length)


def test_hot_minimizers_long_texts_and_many_shards(rows, monkeypatch):
    for name, value in (("HOT", 3), ("CHUNK", 64), ("SHARD_BYTES", 500)):
        monkeypatch.setattr(substrings, name, value)
    check(rows(tangled(1), "doc_id long, text string"), 20)


def test_odd_rows(odd_documents, no_documents):
    check(odd_documents)
    assert substrings.remove_repeats(no_documents).count() == 0


def test_windows_are_judged_on_the_input(rows):
    a, b = " ".join(f"a{i}" for i in range(34)), " ".join(f"b{i}" for i in range(34))
    check(rows([(1, f"{a} x {b}"), (2, f"{a} x"), (3, f"x {b}"), (4, f"{a}"), (5, f"{b} X {a}")], "doc_id long, text string"))


def test_suffix_order_and_backward_search():
    rng = np.random.default_rng(8)
    for _ in range(30):
        text = np.append(rng.integers(1, rng.integers(2, 9), rng.integers(1, 120)), 0)
        order = suffix_order(text, 1000)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        index = FMIndex(text, 12)
        for length in (1, 3, 8):
            starts = np.arange(max(0, len(text) - length))
            want = Counter(tuple(text[i:i + length]) for i in starts)
            assert index.repeated(text, starts, length).tolist() == [want[tuple(text[i:i + length])] > 1 for i in starts]


def test_a_hot_passage_with_one_varying_word_is_spread(rows, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)
    passage = [f"p{i}" for i in range(60)]
    docs = rows([(i, " ".join([*passage[:30], f"name{i}", *passage[31:]])) for i in range(40)], "doc_id long, text string")
    runs = substrings.document_runs(docs, "text", 35)
    found = substrings.sequences(docs, substrings.candidate_runs(runs), "text", 35).collect()
    of: dict = {}
    for r in found:
        if len(r.words.split()) == 35:
            of.setdefault(r.key, set()).add(bytes(r.words))
    assert len(of) > 40 and max(map(len, of.values())) == 1
