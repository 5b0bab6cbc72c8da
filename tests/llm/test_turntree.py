import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from stagecraft.llm import turntree
from stagecraft.runtime import table

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Every node of the trie, from the contract alone."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        turns = (*own.get(base, [])[:h], *own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
        ends[turns].add(c)
    out, kids = [], Counter(p[:-1] for p in members if p)
    sums = defaultdict(lambda: [0, 0])
    for path, who in members.items():
        saved = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            sums[path[:d]][0] += not kids[path]
            sums[path[:d]][1] += saved
    for path, who in members.items():
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), kids[path], *sums[path],
                    hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def check(df):
    got = turntree.prefix_tree(df)
    assert got.columns == COLUMNS and {t for _, t in got.dtypes} == {"bigint", "string"}
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    return rows


def test_conversations(spark, folder):
    check(table(spark, folder, "conversations"))


def made(seed, convs=150, hot=0.4):
    """Conversations that share first turns, one of them very often, copies, and a long one."""
    rng, rows = random.Random(seed), []
    for c in range(convs):
        base = rng.randrange(4)
        n = 70 if c == 3 else rng.randrange(1, 7)
        words = [f"hot {i}" if rng.random() < hot + 0.4 * (base == 0) else f"t{rng.randrange(3)} x{rng.randrange(2)}" for i in range(n)]
        rows += [(c, i, "user" if i % 2 else "assistant", w) for i, w in enumerate(words)]
    return rows


@pytest.mark.parametrize("small", [1, 40, 10_000])
def test_components_split_by_spark_and_in_tasks_give_the_same(rows, monkeypatch, small):
    monkeypatch.setattr(turntree, "SMALL", small)
    monkeypatch.setattr(turntree, "SHARD_NODES", 50)
    monkeypatch.setattr(turntree, "CHUNK", 3)
    check(rows(made(small, 40 if small == 1 else 150), "conv_id long, turn int, role string, text string"))


def test_a_centroid_halves_every_component():
    rng = random.Random(1)
    for shape in (lambda i: i - 1, lambda i: 0, lambda i: rng.randrange(i), lambda i: max(0, i - 1 - rng.randrange(3))):
        n = 3000
        parent = [-1, *[shape(i) for i in range(1, n)]]
        own, values = [rng.randrange(1, 4) for _ in range(n)], [(rng.randrange(100),) for _ in range(n)]
        weight, want = own[:], [v[0] for v in values]
        for i in range(n - 1, 0, -1):
            weight[parent[i]] += weight[i]
            want[parent[i]] += want[i]
        sums = [[0] for _ in range(n)]
        turntree.settle(parent, weight, values, sums)
        assert [s[0] for s in sums] == want


def test_odd_rows(rows):
    data = [(None, 0, "user", "lost"), (0, None, None, None), (0, 1, "a", "x y"), (0, 1, "a", "x y"), (0, 1, "a", None), (5, 0, "a", "x"),
            (7, 2, None, "b c"), (-7, 0, "user", "z"), (-7, 0, "user", "z"), (-20, 0, "r", "q"), (40, 0, "", ""), (41, 0, "u", "only"), (43, 1, "u", "only"),
            (44, 0, "u", "w " * 50_000), (64, 0, "u", "w " * 50_000), (10**15, 1, "ü", "\x0b  ")]
    df = rows(data * 1, "conv_id long, turn int, role string, text string")
    from pyspark.sql import functions as F

    check(df.withColumns({c: F.lit(c) for c in ("key", "conv", "depth", "rank", "comp", "parent")}))
    check(df.where("false"))
    check(df.where("conv_id is null"))
