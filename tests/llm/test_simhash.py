import random
from collections import Counter, defaultdict

import xxhash

from stagecraft.llm import simhash
from stagecraft.llm.graph import connected_components
from stagecraft.runtime import table


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, key in enumerate(ids):
        groups[find(i)].append(key)
    return [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(ids))]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [brute_print(t) for _, t in rows]
    want = Counter(zip([k for k, _ in rows], prints, brute_components([k for k, _ in rows], prints)))
    got = Counter((r.id, r.fingerprint % 2**64, r.component_id) for r in simhash.near_groups(docs).collect())
    assert got == want


def test_every_pair_within_the_radius_collides():
    tables = simhash.masks(2)
    assert len(tables) == 7 and all(27 <= m.bit_count() <= 37 for m in tables)
    for i in range(64):
        for j in range(i + 1):
            assert any(not m & (1 << i | 1 << j) for m in tables)


def test_groups_equal_brute_force(spark, folder):
    check(table(spark, folder, "documents"))


def test_odd_rows(odd_documents, no_documents):
    check(odd_documents)
    check(no_documents)
    assert simhash.keep_one(no_documents).count() == 0


def test_links_join_exactly_the_values_within_two_bits(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(40)}
    for base in list(values):
        for _ in range(rng.randrange(12)):
            base ^= 1 << rng.randrange(64) | 1 << rng.randrange(64) | (1 << rng.randrange(64) if rng.random() < 0.3 else 0)
            values.add(base)
    values = sorted(values)
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fingerprint long")
    links = [(r.u % 2**64, r.v % 2**64) for r in simhash.near_links(frame).collect()]
    assert all(0 < (u ^ v).bit_count() <= 2 for u, v in links)
    roots = {r.node % 2**64: r.root % 2**64 for r in connected_components(simhash.near_links(frame)).collect()}
    wanted = brute_components([simhash.signed(v) for v in values], values)
    assert [simhash.signed(roots.get(v, v)) for v in values] == wanted


def test_components_of_chains_stars_and_loops(spark, rows):
    links = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 300)] + [(400, 400), (None, 5), (7, None), (301, 300)]
    got = dict(connected_components(rows(links, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 300)}, 300: 300, 301: 300}


def test_keep_one_keeps_the_least_of_each_group(odd_documents, spark, folder):
    for docs in (odd_documents, table(spark, folder, "documents")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        wanted = set(brute_components([k for k, _ in rows], [brute_print(t) for _, t in rows]))
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted([r.doc_id for r in kept.select("doc_id").collect()], key=repr) == sorted(wanted, key=repr)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"a{i}" for i in range(1000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole == brute_print(text.decode())


def test_unrelated_groups_under_one_id_or_none_keep_one_each(rows):
    texts = [" ".join(f"{name}{i}" for i in range(30)) for name in "abcdef"]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2].upper()), (7, texts[3]), (7, texts[4]),
            (9, texts[4]), (8, texts[5]), (None, texts[5])]
    kept = Counter((r.doc_id, r.text.lower()) for r in simhash.keep_one(rows(data, "doc_id long, text string")).collect())
    assert kept == Counter([(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5])])
