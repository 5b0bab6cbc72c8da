from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from stagecraft.llm import packing, toxicity
from stagecraft.runtime import store, table
from test_shingles import brute_kept

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]


def stages(spark, docs):
    """What each stage but the last keeps, stored and read again."""
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, FOLDER), "test")
        out[name] = docs
    return out


@pytest.fixture(scope="module")
def kept(spark):
    return stages(spark, table(spark, FOLDER, "documents"))


@pytest.fixture
def odd(spark, odd_documents):
    return stages(spark, odd_documents)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def check_toxicity(spark, kept):
    docs = kept["documents"]
    grammar = toxicity.fit_labels(docs, table(spark, FOLDER, "labels"))
    marker = grammar.marker()
    want = [p for p in pairs(docs) if grammar.score(p[1] or "", marker) < 0.3]
    assert Counter(pairs(kept["toxicity"])) == Counter(want)
    return want


def check_exact(kept):
    before, best = pairs(kept["toxicity"]), {}
    for key, text in before:
        same = (text or "").encode().lower()
        if same not in best or (key is not None, key or 0) > (best[same][0] is not None, best[same][0] or 0):
            best[same] = key, text
    after = pairs(kept["exact dedup"])
    # Of rows equal in id and but for case in text, either may stay.
    assert Counter((k, (t or "").encode().lower()) for k, t in after) == Counter((k, t) for t, (k, _) in best.items())
    assert not Counter(after) - Counter(before)


def check_near(kept):
    assert Counter(k for k, _ in pairs(kept["near dedup"])) == Counter(k for k, _ in brute_kept(pairs(kept["exact dedup"])).elements())
    assert not Counter(pairs(kept["near dedup"])) - Counter(pairs(kept["exact dedup"]))


def check_mix(kept):
    before, after = Counter(pairs(kept["near dedup"])), Counter(pairs(kept["mixing"]))
    assert set(after) <= set(before) and all(n <= 2 * before[p] for p, n in after.items())


def check_packing(spark, mixed):
    pieces = corpus_pipeline.STAGES[-1][1](spark, mixed, FOLDER)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = pieces.collect()
    with open(packing.default_tokenizer(), "rb") as file:
        encode = packing.TokenBytes(file.read(), added=True)
    want, got, filled = Counter(), Counter(), defaultdict(list)
    for key, text in pairs(mixed):
        want[key] += len(encode(text or "")) // 4 + 1
    for p in pieces:
        got[p.doc_id] += p.length
        filled[p.sequence_id].append((p.offset, p.length))
    assert got == want
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_all_but_the_last_return_documents(kept, odd):
    for of in (kept, odd):
        assert all(df.columns == of["documents"].columns for df in of.values())


def test_toxic_documents_go_and_all_others_stay(spark, kept):
    assert len(check_toxicity(spark, kept)) > 150


def test_one_row_of_equal_texts_stays(kept):
    check_exact(kept)


def test_one_document_of_near_copies_stays(kept):
    check_near(kept)


def test_the_mix_holds_whole_documents_at_most_twice(kept):
    check_mix(kept)
    before, taken = ([t for _, t in pairs(kept[name])] for name in ("near dedup", "mixing"))
    total, mixed = (sum(len(t.split()) for t in texts) for texts in (before, taken))
    assert abs(mixed - 1.5 * total) < 0.25 * total


def test_packing_takes_every_token_of_the_mix(spark, kept):
    check_packing(spark, kept["mixing"])


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_odd_rows_pass_through_every_stage(spark, odd):
    check_toxicity(spark, odd)
    check_exact(odd)
    check_near(odd)
    check_mix(odd)
    check_packing(spark, odd["mixing"])
    assert odd["near dedup"].count() >= 5


def test_an_empty_table_stays_empty(spark, no_documents):
    of = stages(spark, no_documents)
    assert all(df.count() == 0 for df in of.values()) and corpus_pipeline.STAGES[-1][1](spark, of["mixing"], FOLDER).count() == 0
