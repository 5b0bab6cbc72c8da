"""Ranked lexical search over a frequency-pattern tree of documents, by branch and bound.

A document is restricted to the terms that some item asks for, and these are ordered by how many documents hold them,
the most frequent first.  Documents dealt out by ranges of these vectors share long beginnings, which are paths of a
trie; a chain without branches is one node and a handful of documents one leaf.  Every node knows, for each term below
it, the greatest frequency and, over all documents below it, the least length weight m.  A score rises with the
frequency and falls with m, so these give an upper bound for any item; the tree is searched depth first, the child with
the highest bound first, and a subtree whose bound cannot reach an item's k-th best score is left out.

Trees hold a bounded number of documents; a task builds one after the other over its range and keeps the best of each
item from tree to tree.  A first search over a sixteenth of the documents gives scores that k documents surely reach,
so later searches start with them; results do not depend on it.

Items are taken in blocks of a bounded number of terms, so that what goes to every task is bounded; each block reads
the documents once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stagecraft.llm.ranks import running
from stagecraft.llm.util import as_bytes, map_arrow
from stagecraft.runtime import store

BLOCK_TERMS = 1 << 18            # terms of the items of one block
TREE_DOCS, TREE_TERMS = 8192, 1 << 20  # documents and vector entries of one tree
LEAF = 64                        # documents of one leaf, but for equal vectors
SEED = 16                        # one in so many documents is searched first

# Letters, digits and every byte of a character beyond ASCII belong to terms; A-Z are lower-cased.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def part_score(tf, m):
    """What one occurrence count adds for each unit of a term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Lists of (row, id, terms) of the items, each list with about ``BLOCK_TERMS`` terms at most."""
    def make():
        def step(batch):
            found = [sorted(set(terms_of(t))) for t in batch.column(2).to_pylist()]
            yield {"row": batch.column(0), "id": batch.column(1), "terms": found, "size": [len(f) for f in found]}
        return step

    kind = items.schema[id_col].dataType.simpleString()
    rows = store(map_arrow(items.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), as_bytes(text_col)),
                           make, f"row long, id {kind}, terms array<binary>, size long").where("size > 0"), "items")
    placed = store(running(rows.select("row", "size"), [F.col("row")], before=F.col("size")).select(
        "row", F.floor(F.col("before") / BLOCK_TERMS).alias("block")), "item-blocks")
    last = placed.agg(F.max("block")).first()[0]
    for block in range(0 if last is None else last + 1):
        if found := [tuple(r) for r in rows.join(placed.where(F.col("block") == block), "row").select("row", "id", "terms").orderBy("row").collect()]:
            yield found


def restricted(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """(row, id, n, terms, tfs) of all documents: the number of their terms, and the counts of those asked for.  Stored."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        number = {t: i for i, t in enumerate(shared.value)}

        def step(batch):
            n, terms, tfs = [], [], []
            for text in batch.column(2).to_pylist():
                parts = terms_of(text)
                counts = Counter(parts)
                found = [t for t in counts if t in number]
                n.append(len(parts))
                terms.append(np.array([number[t] for t in found], "<i4").tobytes())
                tfs.append(np.array([counts[t] for t in found], "<i4").tobytes())
            yield {"row": batch.column(0), "id": batch.column(1), "n": n, "terms": terms, "tfs": tfs}
        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return store(map_arrow(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), as_bytes(text_col)),
                           make, f"row long, id {kind}, n long, terms binary, tfs binary"), "restricted")


def document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": held.astype(np.int32), "n": total[held]})

    counts = np.zeros(size, np.int64)
    for term, n in vectors.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        counts[term] = n
    return counts


class Tree:
    """Documents with sorted vectors: ``path`` holds their terms one after the other, ``starts`` where each begins."""

    def __init__(self, path: np.ndarray, tf: np.ndarray, starts: np.ndarray, m: np.ndarray) -> None:
        self.path, self.starts, self.score = path, starts, part_score(tf, np.repeat(m, np.diff(starts)))
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        parent = self._grow()
        self._bound(parent, tf, m)

    def _grow(self) -> np.ndarray:
        path, starts, parent, ends = self.path, self.starts, [-1], self.starts[1:]
        self.span, self.children = [(0, len(starts) - 1)], [[]]
        todo = [(0, 0)]  # (node, terms that all its documents share)
        while todo:
            node, depth = todo.pop()
            lo, hi = self.span[node]
            if hi - lo <= LEAF:
                continue
            a, b = path[starts[lo] + depth:ends[lo]], path[starts[hi - 1] + depth:ends[hi - 1]]
            both = min(len(a), len(b))
            differ = np.flatnonzero(a[:both] != b[:both])
            if not len(differ) and len(a) == len(b):
                continue  # equal vectors from the first to the last
            depth += int(differ[0]) if len(differ) else both
            at = starts[lo:hi] + depth
            has = at < ends[lo:hi]
            term = np.where(has, path[np.minimum(at, len(path) - 1)].astype(np.int64), -1)
            cuts = [lo, *(np.flatnonzero(np.diff(term)) + 1 + lo).tolist(), hi]
            spans: list[tuple[int, int, bool]] = []  # small neighbours share a leaf
            for x, y in zip(cuts, cuts[1:]):
                if spans and y - spans[-1][0] <= LEAF:
                    spans[-1] = spans[-1][0], y, False
                else:
                    spans.append((x, y, True))
            for x, y, one in spans:
                self.children[node].append(len(parent))
                if one:
                    todo.append((len(parent), depth + 1))
                parent.append(node)
                self.span.append((x, y))
                self.children.append([])
        return np.array(parent)

    def _bound(self, parent: np.ndarray, tf: np.ndarray, m: np.ndarray) -> None:
        """For every node and term below it the greatest frequency, for every node the least m; then both as a score."""
        count, size = len(parent), int(self.path.max()) + 1
        level = np.zeros(count, np.int64)
        for i in range(1, count):  # parents come first
            level[i] = level[parent[i]] + 1
        leaves = [i for i in range(count) if not self.children[i]]
        leaves.sort(key=lambda i: self.span[i])
        least = np.full(count, np.iinfo(np.int64).max)
        least[leaves] = np.minimum.reduceat(m, [self.span[i][0] for i in leaves])
        sizes = [int(self.starts[self.span[i][1]] - self.starts[self.span[i][0]]) for i in leaves]
        keys, most = _greatest(np.repeat(np.array(leaves), sizes) * size + self.path, tf)
        node_of, terms, tfs = [], [], []
        for depth in range(int(level.max()), -1, -1):
            node = keys // size
            here = level[node] == depth
            node_of.append(node[here])
            terms.append(keys[here] % size)
            tfs.append(most[here])
            if depth:
                up = parent[node[here]]
                np.minimum.at(least, parent[np.flatnonzero(level == depth)], least[level == depth])
                keys, most = _greatest(np.concatenate([keys[~here], up * size + keys[here] % size]), np.concatenate([most[~here], most[here]]))
        node, term, greatest = (np.concatenate(x) for x in (node_of, terms, tfs))
        by = np.argsort(term, kind="stable")
        self.node, self.bound = node[by], part_score(greatest[by], least[node[by]]).astype(np.float64)
        self.column = np.searchsorted(term[by], np.arange(size + 1))

    def search(self, terms: np.ndarray, dense: np.ndarray, best: Best) -> None:
        """Offer every document to ``best`` that can be among them; ``dense`` has the item's weight of every term."""
        terms = terms[terms < len(self.column) - 1]
        spans = [slice(self.column[t], self.column[t + 1]) for t in terms.tolist()]
        if not spans:
            return
        weight = np.repeat(dense[terms], [s.stop - s.start for s in spans])
        bounds = np.bincount(np.concatenate([self.node[s] for s in spans]), weight * np.concatenate([self.bound[s] for s in spans]),
                             len(self.children)) * (1 + 1e-9)
        high, todo = bounds.tolist(), [0]
        while todo:
            node = todo.pop()
            if high[node] < best.reach or high[node] <= 0:
                continue
            if self.children[node]:
                todo += sorted(self.children[node], key=high.__getitem__)
                continue
            lo, hi = self.span[node]
            a, b = self.starts[lo], self.starts[hi]
            scores = np.add.reduceat(dense[self.path[a:b]] * self.score[a:b], self.starts[lo:hi] - a)
            found = np.flatnonzero(scores >= best.reach)
            if len(found):
                best.offer(scores[found], found + lo)


def _greatest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, rising, and the greatest value of each."""
    by = np.argsort(keys, kind="stable")
    keys, values = keys[by], values[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.maximum.reduceat(values, first)


class Best:
    """The k best (score, tie order) of one item; ``reach`` is what a document needs to be among them, 1 at least."""

    def __init__(self, k: int, reach: int) -> None:
        self.k, self.reach = k, max(1, reach)
        self.score, self.key = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
        self.keys: np.ndarray  # tie order of the documents of the tree that is searched

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        score, key = np.concatenate([self.score, scores]), np.concatenate([self.key, self.keys[docs]])
        by = np.lexsort((key[:, 2], key[:, 1], key[:, 0], -score))[:self.k]
        self.score, self.key = score[by], key[by]
        if len(by) == self.k:
            self.reach = max(self.reach, int(self.score[-1]))


def search(vectors: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, reach: list[int]) -> DataFrame:
    """(item, score, no_id, id, row): for each item the best of every task's documents.

    ``vectors`` is (row, id, no_id, m, path, tf), ``items`` has the terms and weights of each item.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((items, reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, reach = shared.value
        best, dense = [Best(k, r) for r in reach], np.zeros(size, np.int64)
        held: list[tuple] = []
        amount = 0

        def flush() -> None:
            row, key, no_id, m, path, tf = (list(x) for x in zip(*held))
            lengths = np.array([len(p) // 4 for p in path], np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            tree = Tree(np.frombuffer(b"".join(path), ">u4").astype(np.int64), np.frombuffer(b"".join(tf), "<i4").astype(np.int64), starts, np.array(m, np.int64))
            keys = np.stack([np.array(no_id, np.int64), np.array(key, np.int64), np.array(row, np.int64)], axis=1)
            for (terms, weights), top in zip(items, best):
                dense[terms], top.keys = weights, keys
                tree.search(terms, dense, top)
                dense[terms] = 0

        for batch in batches:
            for doc in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (len(held) == TREE_DOCS or amount + len(doc[4]) // 4 > TREE_TERMS):
                    flush()
                    held, amount = [], 0
                held.append(doc)
                amount += len(doc[4]) // 4
        if held:
            flush()
        for i, top in enumerate(best):
            if len(top.score):
                yield pa.RecordBatch.from_pydict({"item": np.full(len(top.score), i, np.int32), "score": top.score, "no_id": top.key[:, 0].astype(bool),
                                                  "id": top.key[:, 1], "row": top.key[:, 2]})

    # Dealt out by ranges of the vectors' first 16 terms (short keys to sample), so that a task's documents share paths;
    # equal ones are told apart by the row.
    dealt = vectors.select("row", "id", "no_id", "m", "path", "tf").repartitionByRange(F.substring("path", 1, 64), F.col("row")).sortWithinPartitions(
        "path", "row")
    found = dealt.mapInArrow(run, "item int, score long, no_id boolean, id long, row long")
    first = Window.partitionBy("item").orderBy(F.col("score").desc(), "no_id", "id", "row")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, block: list[tuple], id_col: str, text_col: str, k: int, kind: str) -> DataFrame:
    """(item_row, item_id, rank, doc_id, score) of one block of items."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, _, terms in block for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    vectors = restricted(docs, id_col, text_col, vocabulary)
    total, length = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = document_counts(vectors, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(h) + 1))) for h in holding], np.int64)
    place = np.empty(len(vocabulary), np.int64)  # by falling frequency
    place[np.argsort(-holding, kind="stable")] = np.arange(len(vocabulary))
    by_place = np.empty(len(vocabulary), np.int64)
    by_place[place] = weight
    items = []
    for _, _, terms in block:
        at = np.sort(place[[number[t] for t in terms]])
        at = at[by_place[at] > 0]
        items.append((at, by_place[at]))
    shared = spark.sparkContext.broadcast(place.astype(np.int32))

    def make():
        place = shared.value

        def step(batch):
            out: dict[str, list] = {c: [] for c in ("row", "id", "no_id", "m", "path", "tf")}
            for row, key, no_id, n, terms, tfs in zip(*[c.to_pylist() for c in batch.columns]):
                at = place[np.frombuffer(terms, "<i4")]
                by = np.argsort(at)
                for c, v in zip(out, (row, key, no_id, 50 + 50 * n * total // length, at[by].astype(">u4").tobytes(), np.frombuffer(tfs, "<i4")[by].tobytes())):
                    out[c].append(v)
            yield out
        return step

    key = F.col("id").cast("long")
    paths = store(map_arrow(vectors.where(F.octet_length("terms") > 0).select(
        "row", F.coalesce(key, F.lit(2**63 - 1)), key.isNull(), "n", "terms", "tfs"), make,
        "row long, id long, no_id boolean, m long, path binary, tf binary"), "paths")
    some = search(paths.where(F.pmod(F.xxhash64("row"), F.lit(SEED)) == 0), items, len(vocabulary), k, [0] * len(items))
    reach = [0] * len(items)
    for item, score in some.where(F.col("rank") == k).select("item", "score").collect():
        reach[item] = score
    names = spark.createDataFrame([(i, row, key) for i, (row, key, _) in enumerate(block)], f"item int, item_row long, item_id {kind}")
    return search(paths, items, len(vocabulary), k, reach).join(names, "item").select(
        "item_row", "item_id", "rank", F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", k: int = 50) -> DataFrame:
    """(item_row, item_id, rank, doc_id, score): for each item the ``k`` documents with the highest scores above 0.

    Equal scores go to the smaller id, NULL ids last, then to the earlier row.  NULL and empty texts have no terms; such
    items find nothing and such documents are not counted.  Each repeated row is an item or a document of its own, which
    ``item_row`` tells apart.  Very long texts are read whole.  Without items or documents the result is empty, and other
    columns are not read.  Document ids are whole numbers.
    """
    kind = items.schema[item_col].dataType.simpleString()
    out = None
    for block in item_blocks(items, item_col, item_text_col):
        found = search_block(docs, block, id_col, text_col, k, kind)
        found = store(found, "ranked")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return items.sparkSession.createDataFrame([], f"item_row long, item_id {kind}, rank int, doc_id long, score long")
    return out
