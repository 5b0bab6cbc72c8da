import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from stagecraft.llm import bestfit
from stagecraft.llm.words import WordTokenBytes
from stagecraft.runtime import table


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bestfit.default_tokenizer())


@pytest.fixture(scope="module")
def fast():
    with open(bestfit.default_tokenizer(), "rb") as file:
        return WordTokenBytes(file.read(), limit=50)


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


TEXTS = ["", " ", "Don't 'save it'll\tBE 12 34x!!?  ok", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΑΣ. İx é é̇ \x01 a\x00b \xa0\x85 　中文 ﬁ",
         "퟿\U0001f600 x‍y soft\xadhyphen", "ÀÉ ß ẞ Ǆ ŉ ſ ﬀ", "a" * 5000, "\n\n\n", "'S 'LL he'd've"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_odd_texts(tokenizer, fast, text):
    assert np.frombuffer(fast(text), "<u4").tolist() == ids(tokenizer, text)[:-1]


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(" '\tsdtlmverABCäÖñ0 1.,-!<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_of_any_text(tokenizer, fast, text):
    assert np.frombuffer(fast(text), "<u4").tolist() == ids(tokenizer, text)[:-1]


def fewest(items, capacity):
    """The least number of sequences, by search over all packings."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                j = rooms.index(room)
                go(i + 1, [*rooms[:j], room - items[i], *rooms[j + 1:]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng, shrunk = random.Random(3), 0
    for _ in range(400):
        capacity = rng.randrange(8, 40)
        items = [rng.randrange(rng.choice([1, 1, capacity // 4]) or 1, capacity) for _ in range(rng.randrange(1, 10))]
        plan = bestfit.Plan(Counter(items), capacity)
        plan.reduce()
        rest = [w for w, n in plan.left.items() for _ in range(n)]
        assert plan.sequences + fewest(rest, capacity) == fewest(items, capacity), (items, capacity)
        shrunk += len(rest) < len(items)
    assert shrunk > 100


def placed(plan, counts):
    """(sequence, offset, length) of every rank."""
    length = [w for w in sorted(counts) for _ in range(counts[w])]
    out = {}
    for first, n, sequence, offset in plan.runs:
        for k in range(n):
            assert first + k not in out
            out[first + k] = (sequence + k, offset, length[first + k])
    assert sorted(out) == list(range(len(length)))
    return list(out.values())


def gapless(places, capacity):
    at = Counter()
    for sequence, offset, length in sorted(places):
        assert at[sequence] == offset
        at[sequence] += length
    assert all(n <= capacity for n in at.values())
    return len(at)


def test_plans_are_whole_and_close_to_the_bound():
    rng = random.Random(5)
    for n, most in ((1, 50), (500, 50), (3000, 400), (3000, 2047)):
        counts = Counter(rng.randrange(1, most + 1) for _ in range(n))
        plan = bestfit.planned(dict(counts), 2048)
        used = gapless(placed(plan, counts), 2048)
        assert used == plan.sequences
        bound = -(-sum(w * c for w, c in counts.items()) // 2048)
        large = sum(c for w, c in counts.items() if w > 1024)
        assert used <= max(bound, large) * 1.01 + 1
    assert bestfit.planned({}, 2048).runs == []


def test_a_plan_does_not_grow_with_the_documents():
    rng = random.Random(6)
    lengths = rng.sample(range(1, 2048), 300)
    sizes = [len(bestfit.planned({w: rng.randrange(1, 50) * k for w in lengths}, 2048).runs) for k in (1, 100, 10_000)]
    assert max(sizes) < 3 * min(sizes)


def check(got, docs, tokenizer, length):
    by_doc, places = defaultdict(list), []
    for p in got:
        by_doc[p.row].append(p)
        places.append((p.sequence_id, p.offset, p.length))
    used = gapless(places, length)
    want = Counter()
    for key, text in docs:
        all_ids = ids(tokenizer, text)
        want[(key, tuple((i, s, len(all_ids[s:s + length]), zlib.crc32(np.array(all_ids[s:s + length], "<u4").tobytes()))
                         for i, s in enumerate(range(0, len(all_ids), length))))] += 1
    assert Counter((ps[0].id, tuple((p.piece, p.start, p.length, p.crc) for p in sorted(ps, key=lambda p: p.start))) for ps in by_doc.values()) == want
    return used, sum(p.length for p in got)


def test_documents(spark, folder, tokenizer):
    docs = table(spark, folder, "documents")
    used, tokens = check(bestfit.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer, 2048)
    assert used <= -(-tokens // 2048) * 1.03 + 1


def test_odd_documents_and_short_sequences(odd_documents, no_documents, tokenizer):
    docs = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    for length in (2048, 7):
        check(bestfit.pack(odd_documents, length=length).collect(), docs, tokenizer, length)
    assert bestfit.pack(no_documents).collect() == []
