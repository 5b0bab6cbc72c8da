"""Prefix trie of conversations, with subtree totals by centroid decomposition.

Every conversation is a path of turns from a textless root; conversations that begin with the same turns share nodes.
A node is named by its depth and two sums over hashes of (position, turn), which are running sums along a conversation,
so a very long conversation needs no task of its own.

Totals over subtrees come from a centroid decomposition of the parent edges.  Each node weighs as much as conversations
pass through it; the weight of a subtree is then known beforehand, as the number of turns that its conversations still
have.  The centroid of a component is its lowest node with more than half of the weight below it; the nodes with that
much below them are just the path from the centroid to the top.  What hangs below the centroid is totalled once and
added to that path, the path's weights fall by the centroid's, the centroid is settled, and the component falls apart
into the part above and one part for each child, none with more than half of the weight.

Components above a bound are split together, in Spark, one round for each halving; a node knows on which side of the
centroid it lies since its smallest member either passes through the centroid or does not.  Components within the bound
are dealt out to tasks, where the same splitting goes on over arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stagecraft.llm.ranks import running
from stagecraft.llm.util import WORD_PATTERN
from stagecraft.runtime import store

SHARED, MODULUS = 20, 4     # conversations that take their first turns from one, and the bound on how many they take
SMALL = 20_000              # weight, and so nodes at most, of a component that one task settles
SHARD_NODES = 200_000       # nodes of one task, on average
CHUNK = 8192                # ids of one piece of a list of ends
NOBODY = hashlib.sha256(b"").hexdigest()


def numbered(df: DataFrame, key: str, order: list[Column], **sums: Column) -> DataFrame:
    """Add ``rank`` (from 0) and, for each name, the sum over the rows before, within each ``key`` of any size."""
    ranked = store(running(df, [F.col(key), *order], **sums), "ranked")
    starts = ranked.groupBy(key).agg(F.min("rank").alias("from_rank"), *[F.min_by(k, "rank").alias(f"from_{k}") for k in sums])
    return ranked.join(starts, key).withColumns(
        {k: F.col(k) - F.col(f"from_{k}") for k in ("rank", *sums)}).drop("from_rank", *[f"from_{k}" for k in sums])


def turn_rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, mark, words): each turn by its place from 0, the digest of role and text, and its number of words."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("mark"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("words")).where("conv is not null")
    return store(numbered(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("mark")]).select(
        "conv", F.col("rank").alias("pos"), "mark", "words"), "turns")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, mark, words) of the rebuilt conversations, and (conv, length) of all of them."""
    own = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(MODULUS))
    convs = own.withColumns({"head": head, "base": F.col("conv") - F.col("conv") % SHARED})
    given = F.least("head", F.coalesce("lent", F.lit(0)))
    convs = store(convs.join(own.select(F.col("conv").alias("base"), F.col("own").alias("lent")), "base", "left").select(
        "conv", "base", "head", given.alias("given"), (given + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length")), "convs")
    kept = rows.join(convs, "conv").where("pos >= head").select("conv", (F.col("given") + F.col("pos") - F.col("head") + 1).alias("depth"), "mark", "words")
    # At most a few turns of a conversation are lent, to fewer than twice SHARED others.
    lent = rows.where(F.col("pos") < MODULUS - 1).withColumnRenamed("conv", "base").join(convs, "base").where("pos < head").select(
        "conv", (F.col("pos") + 1).alias("depth"), "mark", "words")
    return kept.unionByName(lent), convs.select("conv", "length")


def node_key(depth: Column, a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), a.cast("string"), b.cast("string"))))


def root_key() -> Column:
    zero = F.lit(0).cast("decimal(38,0)")
    return node_key(F.lit(0), zero, zero)


def steps_of(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, length, key, parent, words): the node that each rebuilt conversation reaches at each depth, stored."""
    term = lambda salt: F.xxhash64("depth", "mark", F.lit(salt)).cast("decimal(38,0)")
    marked = rows.withColumns({"term_a": term(1), "term_b": term(2)})
    summed = numbered(marked, "conv", [F.col("depth")], a=F.col("term_a"), b=F.col("term_b"))
    plain = lambda c: c.cast("decimal(38,0)")
    return store(summed.join(lengths, "conv").select(
        "conv", "depth", "length", node_key(F.col("depth"), plain(F.col("a") + F.col("term_a")), plain(F.col("b") + F.col("term_b"))).alias("key"),
        node_key(F.col("depth") - 1, plain(F.col("a")), plain(F.col("b"))).alias("parent"), "words"), "steps")


def nodes_of(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """(key, parent, depth, rep, n, weight, words), a row for each node; the root has no parent.  Stored."""
    root = lengths.agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n"), F.sum(F.col("length") + 1).alias("weight")).where("n > 0").select(
        root_key().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        "rep", "n", "weight", F.lit(0).cast("long").alias("words"))
    return store(steps.groupBy("key", "parent", "depth").agg(
        F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        F.max("words").alias("words")).unionByName(root), "nodes")


def settle(parent: list[int], weight: list[int], values: list[tuple[int, ...]], sums: list[list[int]]) -> None:
    """Add to ``sums`` each node's total over its subtree.  Parents stand before children; a node without one has -1.

    ``weight`` is that of each node's subtree; it is used up.
    """
    children: list[list[int]] = [[] for _ in parent]
    for i, p in enumerate(parent):
        if p >= 0:
            children[p].append(i)
    gone = [False] * len(parent)
    tops = [i for i, p in enumerate(parent) if p < 0]
    while tops:
        path, total = [tops[-1]], weight[tops[-1]]
        while (heavy := next((c for c in children[path[-1]] if not gone[c] and 2 * weight[c] > total), None)) is not None:
            path.append(heavy)
        centroid = path[-1]
        below = [centroid]
        for x in below:
            below += [c for c in children[x] if not gone[c]]
        found, less = [sum(v) for v in zip(*[values[x] for x in below])], weight[centroid]
        for x in path:
            weight[x] -= less
            sums[x] = [s + f for s, f in zip(sums[x], found)]
        gone[centroid] = True
        if len(path) == 1:
            tops.pop()
        tops += [c for c in children[centroid] if not gone[c]]


def subtree_sums(nodes: DataFrame, steps: DataFrame, values: list[str], small: int | None = None) -> DataFrame:
    """(key, sum_<value>...): each node's totals over its subtree, itself included.

    ``nodes`` is one tree from ``root_key`` on, with key, parent, depth, rep (a member, the same for a node and the first of its children that it passes),
    weight and the values; ``steps`` has a row (conv, key, parent) for each step of each member.
    """
    small = SMALL if small is None else small
    sums = [f"sum_{v}" for v in values]
    columns = ["comp", "key", "parent", "depth", "rep", "weight", *values, *sums]
    state = store(nodes.withColumns({"comp": root_key()} | {s: F.lit(0).cast("long") for s in sums}).select(*columns), "components")
    ready, done = [], []
    while True:
        large = store(state.groupBy("comp").agg(F.max("weight").alias("total")).where(F.col("total") > small), "large")
        if large.isEmpty():
            ready.append(state)
            break
        ready.append(state.join(large, "comp", "left_anti"))
        now = store(state.join(large, "comp"), "splitting")
        heavy = F.col("weight") * 2 > F.col("total")
        centroids = store(now.where(heavy).groupBy("comp").agg(F.max_by(F.struct("key", "depth", "weight"), "depth").alias("c")).select(
            "comp", F.col("c.key").alias("centroid"), F.col("c.depth").alias("at"), F.col("c.weight").alias("less")), "centroids")
        # Members that go on below a centroid, each with the child that it takes.
        passing = steps.select(F.col("conv").alias("rep"), F.col("key").alias("child"), F.col("parent").alias("centroid")).join(
            centroids.select("comp", "centroid"), "centroid").drop("centroid")
        split = store(now.join(centroids, "comp").join(passing, ["comp", "rep"], "left").withColumn(
            "below", F.col("child").isNotNull() & (F.col("depth") > F.col("at"))), "split")
        is_centroid = F.col("key") == F.col("centroid")
        found = split.where(F.col("below") | is_centroid).groupBy("comp").agg(*[F.sum(v).alias(f"found_{v}") for v in values])
        on_path = ~F.col("below") & heavy
        summed = split.join(found, "comp").withColumns(
            {s: F.when(on_path, F.col(s) + F.col(f"found_{v}")).otherwise(F.col(s)) for s, v in zip(sums, values)}
            | {"weight": F.when(on_path, F.col("weight") - F.col("less")).otherwise(F.col("weight")), "is_centroid": is_centroid,
               "comp": F.when(F.col("below"), F.col("child")).otherwise(F.col("comp"))})
        summed = store(summed.select("is_centroid", *columns), "summed")
        done.append(summed.where("is_centroid").select("key", *sums))
        state = summed.where("not is_centroid").select(*columns)

    def local(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["depth"], ignore_index=True)
        place = {k: i for i, k in enumerate(part["key"])}
        # A component's top has its parent in another component, or settled before.
        comp = part["comp"].tolist()
        parent = [place.get(p, -1) if p is not None else -1 for p in part["parent"]]
        parent = [p if p >= 0 and comp[p] == comp[i] else -1 for i, p in enumerate(parent)]
        totals = [list(x) for x in zip(*[part[s].tolist() for s in sums])]
        settle(parent, part["weight"].tolist(), list(zip(*[part[v].tolist() for v in values])), totals)
        return pd.DataFrame({"key": part["key"], **{s: [t[i] for t in totals] for i, s in enumerate(sums)}})

    rest = ready[0]
    for more in ready[1:]:
        rest = rest.unionByName(more)
    rest = store(rest, "small")
    shards = max(1, -(-rest.count() // SHARD_NODES))
    out = rest.withColumn("shard", F.pmod(F.xxhash64("comp"), F.lit(shards))).groupBy("shard").applyInPandas(
        local, "key binary, " + ", ".join(f"{s} long" for s in sums))
    for more in done:
        out = out.unionByName(more)
    return out


def ends_digest(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end: their ids, rising and joined by commas, hashed.

    A node's ids are written in pieces by many tasks; only these pieces, in order, are hashed by one.
    """
    ends = steps.where("depth = length").select("key", "conv").unionByName(lengths.where("length = 0").select(root_key().alias("key"), "conv"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        out = lambda: pa.RecordBatch.from_pydict({"key": [key], "first": [ids[0]], "ids": [",".join(map(str, ids)).encode()]})
        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) == CHUNK):
                    yield out()
                    ids = []
                key = k
                ids.append(i)
        if ids:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        out = lambda: pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]})
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    if state is not None:
                        yield out()
                    key, state = k, hashlib.sha256()
                    state.update(text)
                else:
                    state.update(b",")
                    state.update(text)
        if state is not None:
            yield out()

    # Stored, so that the pieces are dealt out by ranges of (key, conv), whatever follows.
    cut = store(ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(pieces, "key binary, first long, ids binary"), "ends")
    return cut.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends_sha256 string")


def prefix_tree(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node.

    Turns are ordered by ``turn``, NULL first, rows of one turn by the SHA-256 of role and text; NULL roles and texts are
    empty; repeated rows are repeated turns.  A conversation is rebuilt from the first turns of the one whose id is its own
    less the (truncated) remainder by 20, as many as CRC-32 of its id leaves modulo 4, and its own turns after as many.
    A node is named by its depth and its smallest member.  Rows without a conversation id belong to no conversation and
    are left out; an empty table has no root and gives an empty result; other columns are not read.
    """
    rows, lengths = rebuilt(turn_rows(turns, conv_col, turn_col, role_col, text_col))
    steps = steps_of(rows, lengths)
    nodes = nodes_of(steps, lengths)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    valued = store(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumns(
        {"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("words")}), "valued")
    sums = subtree_sums(valued, steps, ["leaves", "saved"])
    parents = nodes.select(F.col("key").alias("parent"), F.col("rep").alias("parent_conv_id"))
    ends = ends_digest(steps, lengths)
    return valued.join(sums, "key").join(ends, "key", "left").join(parents, "parent", "left").select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"))
