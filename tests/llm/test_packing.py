import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from stagecraft.llm import packing
from stagecraft.runtime import table


@pytest.fixture(scope="module")
def reference():
    made = Tokenizer.from_file(packing.default_tokenizer())
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def encode():
    with open(packing.default_tokenizer(), "rb") as file:
        return packing.TokenBytes(file.read())


def check(docs, reference, **kw):
    length = kw.get("length", 1024)
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, reference.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in rows), key=repr)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, **kw).collect():
        pieces[r.id, r.row].append(r)
        sequences[r.sequence_id].append(r)
    assert len(pieces) == len(rows)
    left = list(want)
    for (key, _), parts in pieces.items():
        parts.sort(key=lambda r: r.start)
        ids = next(ids for k, ids in left if k == key and len(ids) == parts[0].doc_tokens and all(
            zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes()) == p.crc for p in parts))
        left.remove((key, ids))
        assert [p.start for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        assert sum(p.length for p in parts) == len(ids)
    padding = total = 0
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        n = sum(p.length for p in parts)
        assert 0 < n <= length
        total += n
        padding += 0 if n & (n - 1) == 0 else length - n
    return padding, total


def test_packing_round_trip(spark, folder, reference):
    padding, total = check(table(spark, folder, "documents"), reference)
    assert padding <= 0.02 * total
    check(table(spark, folder, "documents"), reference, group_docs=10, length=64, spare=4)


def test_odd_rows(odd_documents, no_documents, reference):
    padding, total = check(odd_documents, reference)
    assert padding <= 0.02 * total
    assert packing.pack(no_documents).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t \x1fab'sAé!?1<|"), st.characters(codec="utf-8")), max_size=40))
def test_ids_are_the_tokenizers(reference, encode, text):
    assert np.frombuffer(encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_special_strings_are_ordinary_text(reference, encode):
    text = "x <|endoftext|> y<|endoftext|>"
    assert np.frombuffer(encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_first_fit_takes_the_first_bin_with_room():
    rng = random.Random(5)
    for _ in range(50):
        lengths = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 60))), reverse=True)
        free, want = [], []
        for n in lengths:
            b = next((i for i, f in enumerate(free) if f >= n), None)
            if b is None:
                free.append(100)
                b = len(free) - 1
            free[b] -= n
            want.append(b)
        assert packing.first_fit(lengths, 100) == want


def test_a_group_is_packed_whole_and_without_gaps():
    rng = random.Random(6)
    for _ in range(100):
        lengths = [rng.randint(1, 63) for _ in range(rng.randint(1, 80))]
        parts, at = defaultdict(list), defaultdict(list)
        for item, start, size, sequence, offset in packing.pack_group(lengths, 64, 4):
            parts[item].append((start, size))
            at[sequence].append((offset, size))
        assert set(parts) == set(range(len(lengths)))
        for spans, whole in [(parts[i], n) for i, n in enumerate(lengths)] + [(s, None) for s in at.values()]:
            end = 0
            for start, size in sorted(spans):
                assert start == end
                end += size
            if whole is None:
                assert end & (end - 1) == 0 or 64 - 4 <= end <= 64
            else:
                assert end == whole


@pytest.fixture(scope="module")
def unchanged():
    return Tokenizer.from_file(packing.default_tokenizer())


@pytest.fixture(scope="module")
def encode_added():
    with open(packing.default_tokenizer(), "rb") as file:
        return packing.TokenBytes(file.read(), added=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.just("<|endoftext|>"), st.text(alphabet=st.sampled_from(" \nab'é<|>"), max_size=8)), max_size=6))
def test_added_tokens_get_the_ids_of_an_unchanged_tokenizer(unchanged, encode_added, parts):
    text = "".join(parts)
    assert np.frombuffer(encode_added(text), "<u4").tolist() == unchanged.encode(text, add_special_tokens=False).ids


def test_the_query_gives_the_ids_of_an_unchanged_tokenizer(spark, unchanged, tmp_path):
    from stagecraft.llm.queries import QUERIES

    text = "a <|endoftext|> b"
    assert unchanged.encode(text, add_special_tokens=False).ids == [64, 220, 50256, 275]
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows, ids = QUERIES["op1_pack_sequences"](spark, str(tmp_path)).collect(), np.array([64, 220, 50256, 275, 0], "<u4")
    assert sum(r.length for r in rows) == 5
    assert all(r.doc_tokens == 5 and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in rows)


def test_a_tokenizers_memory_goes_with_it():
    import gc
    import weakref

    with open(packing.default_tokenizer(), "rb") as file:
        encode = packing.TokenBytes(file.read())
    encode("one two two")
    kept = weakref.ref(encode.known)
    gc.disable()
    try:
        del encode
        assert kept() is None
    finally:
        gc.enable()
