import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from stagecraft.llm import shingles
from stagecraft.llm.exact_dedup import Screen
from stagecraft.runtime import table


def brute_kept(rows):
    """(id, text) of the least id of each component of "five-word shingles have a similarity of 0.8 or more"."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        at = find(i)
        if at not in least or (row[0] is not None, -(row[0] or 0)) > (least[at][0] is not None, -(least[at][0] or 0)):
            least[at] = row
    return Counter(least.values())


def varied(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.random()}"
    return " ".join(words)


def made(seed=4):
    """Copies with up to six changed words in groups of several sizes, and chains of them."""
    rng, texts = random.Random(seed), []
    for g in range(40):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.choice([60, 150, 400]))]
        texts += [varied(rng, base, rng.randrange(7)) for _ in range(rng.choice([1, 2, 3, 12]))]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_pipeline_keeps_one_of_each_group_of_similarity_0_8(spark, rows):
    data = made()
    kept = corpus_pipeline.drop_near_copies(spark, rows(data, "doc_id long, text string"), None)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == brute_kept(data)


def test_documents_as_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    kept = shingles.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k for k, _ in brute_kept([(r.doc_id, r.text) for r in docs.collect()]).elements())


def test_ids_missing_or_repeated(rows):
    texts = [" ".join(f"{name}{i}" for i in range(30)) for name in "abcdef"]
    data = [(None, texts[0]), (None, texts[1]), (7, texts[3]), (7, texts[4]), (8, texts[5]), (None, texts[5].upper()), (None, None)]
    kept = shingles.keep_one(rows([*data, (None, " ")], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, (r.text or "").strip()) for r in kept) == Counter((k, t or "") for k, t in data if t != texts[5].upper())


def test_pairs_at_the_threshold_share_a_bucket():
    rng, missed = np.random.default_rng(2), 0
    for _ in range(2000):
        common, own = rng.integers(0, 1 << 64, 80, np.uint64), rng.integers(0, 1 << 64, (2, 10), np.uint64)
        a, b = (shingles.band_keys(np.concatenate([common, o])) for o in own)
        missed += not set(a) & set(b)
    assert missed <= 3


def test_a_pair_that_meets_in_no_band_is_found(rows):
    words = [f"p5011w{j}" for j in range(9)]
    a, b = (shingles.shingle_set(" ".join(w).encode(), 5) for w in (words, words[:8]))
    assert shingles.alike(a, b, 0.8) and not set(shingles.band_keys(a)) & set(shingles.band_keys(b))
    data = [(1, " ".join(words)), (2, " ".join(words[:8])), (3, " ".join(words[:7]))]  # 3 is alike 2 by 3 of 4 only
    kept = shingles.keep_one(rows(data, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_alike_sets_meet_in_a_prefix_and_pass_the_sketch():
    rng = np.random.default_rng(3)
    for _ in range(500):
        n = int(rng.integers(1, 400))
        whole = rng.integers(0, 1 << 64, n + n // 2, np.uint64)
        a, b = (np.unique(rng.permutation(whole)[:int(rng.integers(max(1, n - n // 5), n + 1))]) for _ in range(2))
        both = np.unique(np.concatenate([a, whole[:n // 4]]))
        for x, y in ((a, b), (a, both), (a, a[:max(1, -(-len(a) * 4 // 5))])):
            if shingles.alike(x, y, 0.8):
                marks = [(s >> np.uint64(3)) % np.uint64(2) == 0 for s in (x, y)]
                assert set(shingles.prefix(x, marks[0], 0.8).tolist()) & set(shingles.prefix(y, marks[1], 0.8).tolist())
                assert shingles.can_be_alike(shingles.sketch(x), shingles.sketch(y), 0.8)
    for n in (100, 20_000):
        sets = [np.sort(rng.integers(0, 1 << 64, n, np.uint64)) for _ in range(2)]
        assert not shingles.can_be_alike(*map(shingles.sketch, sets), 0.8)
    crowded = [np.arange(n, dtype=np.uint64) for n in (3000, 2500)]
    assert shingles.can_be_alike(*map(shingles.sketch, crowded), 0.8)


def test_sizes_that_allow_the_similarity_share_a_range(spark):
    pairs = [(b * 4 // 5 + (b * 4 % 5 > 0), b) for b in range(1, 3000)]
    members = spark.createDataFrame([(b, f"{i}".encode(), n) for b, p in enumerate(pairs) for i, n in enumerate(p)], "bucket long, node binary, size long")
    met = shingles.by_size(members, 0.8).groupBy("bucket").agg(F.countDistinct("node").alias("n")).where("n > 1")
    assert met.count() >= len(pairs)
    assert shingles.by_size(members.where("size = 2").limit(1).unionByName(members.where("size = 4").limit(1)), 0.8).groupBy("bucket").count().where("count > 1").count() == 0


def boilerplate(n, seed=9):
    """Texts that share 60 of 100 words; a few have a near copy."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(60)]
    texts = [" ".join(common + [f"u{k}x{i}" for i in range(40)]) for k in range(n)]
    return texts + [t.replace(f"u{k}x7", "changed") for k, t in enumerate(texts[:10])]


def test_comparisons_of_unlike_texts_grow_with_their_number(rows, monkeypatch):
    from stagecraft.runtime import store

    compared, plain = [], shingles.likely

    def counting(pairs, *rest):
        pairs = store(pairs, "counted")
        compared[-1] += pairs.count()
        return plain(pairs, *rest)

    monkeypatch.setattr(shingles, "likely", counting)
    for n in (200, 800):
        compared.append(0)
        data = list(enumerate(boilerplate(n)))
        kept = shingles.keep_one(rows(data, "doc_id long, text string"))
        assert sorted(r.doc_id for r in kept.collect()) == list(range(n))
    assert compared[1] < 5 * compared[0] and compared[1] < 800 * 8


def spread(n, seed=3):
    """Copies of one text with up to a third of the words changed: many are as like as the threshold, chains join them."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    return [(i, varied(rng, base, rng.randrange(12))) for i in range(n)]


def test_many_copies_about_as_like_as_the_threshold(rows, monkeypatch):
    data = spread(250)
    for few, rounds, outside in ((0, 1, 1000), (1, 2, 1 << 18)):
        for name, value in (("FEW", few), ("ROUNDS", rounds), ("OUTSIDE", outside), ("SLICE", 4500)):
            monkeypatch.setattr(shingles, name, value)
        kept = shingles.keep_one(rows(data, "doc_id long, text string"))
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == brute_kept(data)


def test_blocks_join_what_all_pairs_join():
    rng = np.random.default_rng(1)
    for similarity in (450, 500, 550):
        sets = [np.unique(rng.choice(60, 60)).astype(np.uint64) for _ in range(80)]
        roots = [bytes([i // 2]) for i in range(80)]
        found = shingles.block_links(sets[:30], sets, roots[:30], roots, similarity)
        assert all(shingles.alike(sets[i], sets[j], similarity / 1000) for i, j in found)

        def joined(pairs):
            group = {r: {r} for r in roots}
            for i, j in pairs:
                if group[roots[i]] is not group[roots[j]]:
                    group[roots[i]] |= group[roots[j]]
                    for r in group[roots[j]]:
                        group[r] = group[roots[i]]
            return {frozenset(g) for g in group.values()}

        want = joined((i, j) for i in range(30) for j in range(80) if shingles.alike(sets[i], sets[j], similarity / 1000))
        assert joined(found) == want and len(found) == 40 - len(want)


def test_odd_documents(odd_documents, no_documents):
    kept = shingles.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    data = [(r.doc_id, r.text) for r in odd_documents.collect()]
    ids = Counter(r.doc_id for r in kept.collect())
    # Id 2 has a copy of document 1 twice, and a text of its own; 5 and the NULL ids have no words, as 3 has; 6 is 4 in capitals.
    assert ids == Counter({1: 1, 2: 1, 3: 1, 4: 1, 7: 1, 8: 1, 9: 1}) == Counter(k for k, _ in brute_kept(data).elements())
    assert shingles.keep_one(no_documents).collect() == []


def test_texts_that_meet_no_other_are_not_shuffled(rows):
    data = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(60)] + [(60, " ".join(f"w7x{j}" for j in range(20)) + " .")]
    docs = rows(data, "doc_id long, text string")
    nodes = docs.where("doc_id < 3").select(shingles.node_column("text").alias("node"))
    known = Screen(nodes.select(shingles.node_key(F.col("node")).alias("key")))
    met = shingles.member_texts(docs, nodes, known, "text")
    assert met.count() == 3
    assert docs.select(known.column(shingles.node_key(shingles.node_column("text"))).alias("m")).where("m").count() < 10
    kept = shingles.keep_one(docs)
    # The rows that the filter lets pass reach the result beside the join.
    assert "Union" in kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_screen_has_no_false_negatives(spark):
    for n, shard_keys in ((0, 10), (1, 10), (1000, 10), (1000, 2000)):
        keys = spark.range(n).select(F.xxhash64("id").alias("key"))
        maybe = Screen(keys, shard_keys).column(F.xxhash64("id"))
        found = [r.id for r in spark.range(5000).where(maybe).collect()]
        assert set(range(n)) <= set(found) and len(found) <= n + 200
