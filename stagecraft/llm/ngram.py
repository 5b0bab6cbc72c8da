"""Language-model scores from Elias-Fano n-gram tries.

Counts come from all training documents.  The model is an interpolated trigram model with absolute
discounting over an add-0.1 unigram model of every training word; n-grams of all words and all counts take
part.  They stand in tries, one for each shard of the middle words: a level is one Elias-Fano sequence of
context * vocabulary + word with a monotone pointer per context, a byte per n-gram for its probability and
one for its back-off, each an index into 256 quantile means.  A lookup is a successor search inside the
context's range.

Every token goes once, with the two before it, to the shard of its middle word, in compressed columns.  There the
training tokens make the trie and all tokens are looked up in it: all n-grams a token's probability needs
share the middle word.  The number of shards follows the number of tokens.  A word too frequent for one shard is
split by the word before it; its pairs are counted beforehand and sent to each of its shards.  Discounts are
estimated for each middle word (of a split one, those of its trigrams in each shard).

A shard gives a token's probability as ``seen + back * p1`` with the unigram probability p1.  Counts of the ``hot``
most frequent words travel with the task; for all other words the two numbers are joined with the whole count table.
Those words are told apart by 63 bits of their XXH64: among a billion words some two share it with a chance of about 0.05.
"""

from __future__ import annotations

import mmap
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stagecraft.llm.eliasfano import EliasFano
from stagecraft.llm.util import as_bytes, release
from stagecraft.runtime import store

END = b""            # no word is empty
FLUSH = 2_000_000    # tokens held by a task before it passes them or their counts on
BLOCK = 600_000      # tokens in one block of a shard: three codes of its words fit 63 bits
START = 1 << 62      # code of what stands before a document
SMOOTH = 0.1


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): every token of the documents, the end of each as the empty word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(text.lower().split())
            held[END] += batch.num_rows
            if len(held) > FLUSH // 8:
                yield rows(held)
                held = Counter()
        yield rows(held)

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return docs.select(as_bytes(text_col)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Codes(dict):
    """Word -> its rank among the hot words, of any other word a hash below zero."""

    def __missing__(self, word: bytes) -> int:
        return ~(xxhash.xxh64_intdigest(word, 42) >> 1)


def hash_code(word: str) -> Column:
    """The code of a word that is not hot."""
    return F.bitwise_not(F.shiftrightunsigned(F.xxhash64(word), 1))


def token_codes(texts: list[bytes], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w, sizes): codes of the two tokens before each token and its own, and each text's number of tokens.

    Before the first word stands the end of a document, and before that ``START``.
    """
    tokens: list[bytes] = []
    sizes = []
    for text in texts:
        before = len(tokens)
        tokens += text.lower().split()
        tokens.append(END)
        sizes.append(len(tokens) - before)
    w = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
    v = np.concatenate([[codes[END]], w[:-1]])
    u = np.concatenate([[START], v[:-1]])
    u[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)] = START
    return u, v, w, np.array(sizes, np.int64)


def split_pairs(docs: DataFrame, text_col: str, ids: dict[bytes, int], parts: np.ndarray) -> DataFrame:
    """(v, w, n): how often each token follows each of the words that are split (those with more than one part)."""
    spread = docs.sparkSession.sparkContext.broadcast((ids, np.append(parts, 1) > 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, split = Codes(spread.value[0]), spread.value[1]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        buffered = 0

        def counted():
            v, w = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((w, v))
            v, w = v[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
            n = np.diff(np.append(first, len(v)))
            for at in range(0, len(first), 200_000):
                cut = first[at:at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(v[cut]), pa.array(w[cut]), pa.array(n[at:at + 200_000])], names=["v", "w", "n"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            _, v, w, _ = token_codes(batch.column(0).to_pylist(), codes)
            some = split[np.where((v >= 0) & (v < len(split)), v, -1)]
            held.append((v[some], w[some]))
            buffered += int(some.sum())
            if buffered > FLUSH:
                yield from counted()
                buffered = 0
        if buffered:
            yield from counted()
        release()

    return docs.select(as_bytes(text_col)).mapInArrow(run, "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers, rising; by a sort, several times as fast as ``np.unique`` without places."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shard_of(u: np.ndarray, v: np.ndarray, parts: np.ndarray, shards: int) -> np.ndarray:
    """The shard of the middle word ``v``; the first words have ``parts`` shards each, chosen by the word before."""
    wide = np.append(parts, 1).astype(np.uint64)[np.where((v >= 0) & (v < len(parts)), v, -1)]
    return ((mixed(v) % np.uint64(shards) + mixed(u) % wide) % np.uint64(shards)).astype(np.int64)


class Block:
    """Tokens of one shard in the order of their documents: (row, held out, tokens) of each document, the rising codes
    of all words, and the place there of each token and of the two before it."""

    TYPES = ("<i8", "u1", "<i4", "<i8", "<i4", "<i4", "<i4")

    def __init__(self, data: bytes) -> None:
        size, documents, words, tokens = np.frombuffer(data, "<i8", 4).tolist()
        raw = np.frombuffer(pa.decompress(data[32:], size, codec="zstd"), np.uint8)
        at, found = 0, []
        for kind, n in zip(self.TYPES, (documents,) * 3 + (words,) + (tokens,) * 3):
            width = np.dtype(kind).itemsize
            found.append(np.ascontiguousarray(raw[at:at + n * width].reshape(width, n).T).view(kind).reshape(n))
            at += n * width
        self.rows, self.held, self.sizes, self.words, *places = found
        self.u, self.v, self.w = (x.astype(np.int64) for x in places)

    @classmethod
    def packed(cls, document: np.ndarray, rows: np.ndarray, held: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> bytes:
        """``document`` is the place of a token's document in ``rows`` and ``held`` and rises."""
        first = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]]))
        words, places = np.unique(np.concatenate([u, v, w]), return_inverse=True)
        columns = [rows[document[first]], held[document[first]], np.diff(np.append(first, len(document))), words, *np.split(places, 3)]
        # The bytes of equal weight stand together, so most of them are zeros.
        raw = b"".join([c.astype(kind).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, kind in zip(columns, cls.TYPES)])
        return np.array([len(raw), len(first), len(words), len(w)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)

    def triples(self) -> tuple[np.ndarray, ...]:
        """(u, v, w, n, at): the different triples, how often each is in training documents, and which one each token is."""
        size = len(self.words)
        key, at = np.unique((self.u * size + self.v) * size + self.w, return_inverse=True)
        n = np.bincount(at, np.repeat(self.held == 0, self.sizes), len(key)).astype(np.int64)
        return key // size // size, key // size % size, key % size, n, at.astype(np.int32)


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """256 quantile means and the index of each value's mean."""
    if not len(values):
        return np.zeros(256), np.zeros(0, np.uint8)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 257)[1:-1]))
    code = np.searchsorted(edges, values, "right")
    sums, n = np.bincount(code, values, 256), np.bincount(code, minlength=256)
    return np.where(n > 0, sums / np.maximum(n, 1), 0.0), code.astype(np.uint8)


class Trie:
    """Levels of pairs and triples.  ``parts`` are the byte arrays of its buffers, in a fixed order."""

    def __init__(self, buffer) -> None:
        whole = np.frombuffer(buffer, np.uint8)
        count = int(whole[:8].view("<i8")[0])
        spans = whole[8:8 + 16 * count].view("<i8").reshape(-1, 2)
        parts = iter([whole[a:a + n] for a, n in spans.tolist()])
        self.size = int(next(parts).view("<i8")[0])
        self.back1 = next(parts).view("<f8")[next(parts)]
        self.levels = []
        for _ in (2, 3):
            pointers, words = EliasFano(parts), EliasFano(parts)
            self.levels.append((pointers, words, next(parts).view("<f8"), next(parts), next(parts).view("<f8"), next(parts)))

    @staticmethod
    def build(size: int, log_p1: np.ndarray, pairs: np.ndarray, pair_n: np.ndarray, triples: np.ndarray, triple_n: np.ndarray,
              totals: np.ndarray, pair_totals: np.ndarray, discounts: tuple[float, float]) -> bytes:
        """``pairs`` (v * size + w) and ``triples`` ((u * size + v) * size + w) rise; ``totals`` are counts of the context
        tokens, ``pair_totals`` those of the pairs as contexts.  Triples whose context is not among the pairs are left out."""
        context = triples // size
        at = np.searchsorted(pairs, context)
        ok = (at < len(pairs)) & (pairs[np.minimum(at, max(len(pairs) - 1, 0))] == context) if len(pairs) else np.zeros(len(triples), bool)
        return Trie.placed(size, log_p1, pairs, pair_n, at[ok], triples[ok] % size, triple_n[ok], totals, pair_totals, discounts)

    @staticmethod
    def placed(size: int, log_p1: np.ndarray, pairs: np.ndarray, pair_n: np.ndarray, at: np.ndarray, last: np.ndarray, triple_n: np.ndarray,
               totals: np.ndarray, pair_totals: np.ndarray, discounts: tuple) -> bytes:
        """``build`` with triples as the places ``at`` of their contexts among the pairs and their last words, in rising order;
        a discount is one number or one for each n-gram."""
        v, w = pairs // size, pairs % size
        seen = (pair_n - discounts[0]) / totals[v]
        gamma1 = np.clip(1 - np.bincount(v, seen, size), 1e-9, 1)
        p2 = seen + gamma1[v] * 10 ** log_p1[w]
        context = pairs[at]
        seen3 = (triple_n - discounts[1]) / pair_totals[at]
        gamma2 = np.clip(1 - np.bincount(at, seen3, len(pairs)), 1e-9, 1)
        # The shorter context of (u, v) is v: the lower-order probability of w after v.
        lower_key = context % size * size + last
        j = np.searchsorted(pairs, lower_key)
        j = np.minimum(j, max(len(pairs) - 1, 0))
        is_pair = pairs[j] == lower_key if len(pairs) else np.zeros(0, bool)
        lower = np.where(is_pair, p2[j], gamma1[context % size] * 10 ** log_p1[last]) if len(pairs) else np.zeros(0)
        p3 = seen3 + gamma2[at] * lower

        parts = [np.array([size], "<i8").view(np.uint8)]
        table, code = quantised(np.log10(gamma1))
        parts += [table.astype("<f8").view(np.uint8), code]
        for contexts, owner, word, p, gamma in ((size, v, w, p2, gamma2), (len(pairs), at, last, p3, np.zeros(0))):
            pointers = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=contexts))]).astype(np.int64)
            parts += EliasFano.encode(pointers, len(owner) + 1)
            parts += EliasFano.encode(owner * size + word, max(1, contexts * size))
            for values in (np.log10(p), np.log10(gamma)):
                table, code = quantised(values)
                parts += [table.astype("<f8").view(np.uint8), code]
        room = [len(p) + -len(p) % 8 for p in parts]  # each buffer starts at a multiple of eight
        starts = 8 + 16 * len(parts) + np.concatenate([[0], np.cumsum(room)[:-1]])
        spans = np.stack([starts, [len(p) for p in parts]], axis=1)
        return b"".join([np.array([len(parts)], "<i8").tobytes(), spans.astype("<i8").tobytes(),
                         *[p.tobytes().ljust(n, b"\0") for p, n in zip(parts, room)]])

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """The trie over a memory map of a file that has no name and goes with the process."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            return cls(mmap.mmap(file.fileno(), len(data), access=mmap.ACCESS_READ))

    def _child(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        pointers, words = self.levels[level][:2]
        return words.find(context * self.size + word, pointers.access(context), pointers.access(context + 1))

    def log_p(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, log_p1: np.ndarray) -> np.ndarray:
        """log10 of each word's probability after its context; ids outside the vocabulary are negative."""
        size = self.size
        u, v, w = (np.where(x < size, x, -1) for x in (u, v, w))
        out = log_p1.astype(np.float64).copy()
        has1 = np.flatnonzero(v >= 0)
        out[has1] += self.back1[v[has1]]
        two = np.flatnonzero((v >= 0) & (w >= 0))
        key, back = np.unique(v[two] * size + w[two], return_inverse=True)
        at = self._child(0, key // size, key % size)[back]
        hit = at >= 0
        _, _, table2, code2, back2, bcode2 = self.levels[0]
        out[two[hit]] = table2[code2[at[hit]]]
        context = np.flatnonzero((u >= 0) & (v >= 0))
        key, back = np.unique(u[context] * size + v[context], return_inverse=True)
        pair = self._child(0, key // size, key % size)[back]
        context, pair = context[pair >= 0], pair[pair >= 0]
        out[context] += back2[bcode2[pair]]
        inner = w[context] >= 0
        context, pair = context[inner], pair[inner]
        key, back = np.unique(pair * size + w[context], return_inverse=True)
        at = self._child(1, key // size, key % size)[back]
        hit = at >= 0
        _, _, table3, code3, _, _ = self.levels[1]
        out[context[hit]] = table3[code3[at[hit]]]
        return out

    def places(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where (v, w), (u, v) and (u, v, w) stand in their levels, -1 if nowhere; all words are known."""
        pair, context = self._child(0, v, w), self._child(0, u, v)
        triple, some = np.full(len(w), -1), np.flatnonzero(context >= 0)
        triple[some] = self._child(1, context[some], w[some])
        return pair, context, triple

    def split_p(self, v: np.ndarray, pair: np.ndarray, context: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seen, back) of words at such places (and the words before them), from a trie built with unigrams of probability 0: the probability is
        ``seen + back * p1``.  The pair of a word whose triple has a place is not asked for."""
        _, _, table2, code2, back2, bcode2 = self.levels[0]
        _, _, table3, code3, _, _ = self.levels[1]
        gamma, seen = np.ones(len(v)), np.zeros(len(v))
        known = np.flatnonzero(context >= 0)
        gamma[known] = (10 ** back2)[bcode2[context[known]]]
        known = np.flatnonzero(triple >= 0)
        seen[known] = (10 ** table3)[code3[triple[known]]]
        rest = np.flatnonzero((triple < 0) & (pair >= 0))
        seen[rest] = gamma[rest] * 10 ** table2[code2[pair[rest]]]
        return seen, gamma * 10 ** self.back1[v]


def discounts(group: np.ndarray, n: np.ndarray, groups: int) -> np.ndarray:
    """The absolute discount of each group of counts, by how many are one and how many two."""
    one, two = np.bincount(group[n == 1], minlength=groups), np.bincount(group[n == 2], minlength=groups)
    return np.where(one + two > 0, np.clip(one / np.maximum(one + 2 * two, 1), 0.1, 0.95), 0.5)


def shard_scores(blocks: list[bytes], listed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """A shard's blocks with (seen, back) of each token, from the trie of its training tokens.

    ``listed`` are (v, w, n) of all pairs of the split words.
    """
    words = distinct(np.concatenate([listed[0], *(Block(b).words for b in blocks)]))
    size = len(words) + 1  # the last place is for words that follow a split word in other shards only
    found, asked = [], []
    for block in map(Block, blocks):
        place = np.searchsorted(words, block.words)
        u, v, w, n, at = block.triples()
        u, v, w = place[u], place[v], place[w]
        own = n > 0
        found.append((u[own] * size + v[own], w[own], n[own]))
        asked.append((at, own, v.astype(np.int32), u[~own].astype(np.int32), w[~own].astype(np.int32)))
    context, last, n = (np.concatenate(x) for x in zip(*found))
    del found
    contexts, of = np.unique(context, return_inverse=True)
    key, triple = np.unique(of * size + last, return_inverse=True)
    triple, entry = triple.astype(np.int32), of.astype(np.int32)  # places of what is found in each block
    n = np.bincount(triple, n, len(key))
    of, last = key // size, key % size
    del context, key
    middle = contexts[of] % size
    discount3 = discounts(middle, n, size)[middle]
    context_n = np.bincount(of, n, len(contexts))

    pairs, at = np.unique(middle * size + last, return_inverse=True)
    pair_n = np.bincount(at, n, len(pairs))
    del middle, at
    v, w = np.searchsorted(words, listed[0]), np.searchsorted(words, listed[1])
    w[words[np.minimum(w, size - 2)] != listed[1]] = size - 1
    if len(v):
        split = np.zeros(size, bool)
        split[v] = True
        own = ~split[pairs // size]
        pairs, pair_n = np.append(pairs[own], v * size + w), np.append(pair_n[own], listed[2])
    discount2 = discounts(pairs // size, pair_n, size)
    totals = np.bincount(pairs // size, pair_n, size)
    if len(v):  # all pairs of one split word with words that are not here become one pair of the same discounted weight
        pairs, at = np.unique(pairs, return_inverse=True)
        pair_n = np.bincount(at, pair_n, len(pairs)) - discount2[pairs // size] * (np.bincount(at, minlength=len(pairs)) - 1)

    nodes = distinct(np.concatenate([pairs, contexts]))
    of_pair, of_context = np.searchsorted(nodes, pairs), np.searchsorted(nodes, contexts)
    node_n, context_total = np.ones(len(nodes)), np.ones(len(nodes))
    context_total[of_context] = node_n[of_context] = context_n
    node_n[of_pair] = pair_n
    del pairs, pair_n, of_pair, contexts, context_n
    first = nodes // size
    totals = np.where(totals > 0, totals, np.maximum(1, np.bincount(first, node_n, size)))  # of other shards' words: not looked up
    trie = Trie.mapped(Trie.placed(size, np.full(size, -np.inf), nodes, node_n, of_context[of], last, n, totals, context_total,
                                   (discount2[first], discount3)))
    del nodes, node_n, context_total, first, totals, of, last, n, discount3
    begin = 0
    for block, (at, own, v, u, w) in zip(map(Block, blocks), asked):
        # Triples of training documents have known places, all others are looked up.
        end = begin + int(own.sum())
        pair, context, three = (np.full(len(v), -1) for _ in range(3))
        context[own], three[own] = of_context[entry[begin:end]], triple[begin:end]
        pair[~own], context[~own], three[~own] = trie.places(u.astype(np.int64), v[~own].astype(np.int64), w.astype(np.int64))
        seen, back = trie.split_p(v, pair, context, three)
        yield block, seen[at], back[at]
        begin = end


def _cutoff(counts: DataFrame, kept: int) -> int:
    """The least count, 2 or more, from which on at most ``kept`` rows are left; counts are told apart by steps of 4 %."""
    steps = counts.groupBy(F.least(F.ceil(F.log2(F.col("n").cast("double")) * 16), F.lit(1000)).alias("step")).agg(
        F.count(F.lit(1)).alias("size"), F.min("n").alias("from")).orderBy(F.col("step").desc()).collect()
    total, least = 0, 1 << 62
    for s in steps:
        total += s["size"]
        if total > kept or s["from"] < 2:
            break
        least = s["from"]
    return least


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 8192,
                    hot: int = 131_072, kept: int = 1_250_000) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document.

    ``held_out`` (a condition on the table's columns, NULL counts as False) says which documents take no part
    in learning.  Tokens are words, lower-cased in A-Z, and one end; NULL counts as an empty text.  Without
    training documents every token is unknown.  Repeated rows are learned from and scored each time, an empty
    table gives an empty result, other columns are not read.

    A shard's trie holds the n-grams of about ``kept`` training tokens.  Of the ``vocabulary`` most frequent tokens those that
    occur more than ``kept`` / 2 times are split.  All three numbers say only what is held where; no n-gram is left out.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    train = docs.where(~held)
    counts = store(word_counts(train, text_col), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    scale = float(np.log10(total + SMOOTH * (distinct + 1)))
    # A bounded head of the vocabulary, collected as columns, most frequent first.
    top = counts.where(F.col("n") >= _cutoff(counts, hot)).toArrow()
    words, n_of = top["word"].to_pylist(), top["n"].to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n_of[i], words[i]))
    ids, n_of = {words[i]: rank for rank, i in enumerate(order)}, n_of[order]
    del top, words, order
    shards = max(1, -(-total // kept))
    parts = np.minimum(-(-n_of[:vocabulary] // max(1, kept // 2)), shards).astype(np.int64)
    spread = spark.sparkContext.broadcast((ids, parts, np.log10(n_of + SMOOTH) - scale))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"shard long, block binary, row long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with its sums over hot words, and the blocks of all shards."""
        ids, parts, log_p1 = spread.value
        codes = Codes(ids)
        held: list[tuple] = []

        def blocks():
            rows, out, sizes, u, v, w = (np.concatenate(x) for x in zip(*held))
            held.clear()
            document = np.repeat(np.arange(len(rows)), sizes)
            place = shard_of(u, v, parts, shards)
            order = np.argsort(place, kind="stable")
            ends = np.cumsum(np.bincount(place, minlength=shards))
            for shard in np.unique(place).tolist():
                begin, end = int(ends[shard - 1]) if shard else 0, int(ends[shard])
                for at in range(begin, end, BLOCK):
                    own = order[at:min(end, at + BLOCK)]
                    block = Block.packed(document[own], rows, out, u[own], v[own], w[own])
                    yield pa.RecordBatch.from_pydict({"shard": [shard], "block": [block], **{k: [None] for k in arrow.names[2:]}}, schema=arrow)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            u, v, w, sizes = token_codes(batch.column(3).to_pylist(), codes)
            rows = batch.column(0).to_numpy()
            is_hot = w >= 0
            of = np.repeat(np.arange(n), sizes)[is_hot]
            yield pa.RecordBatch.from_arrays([
                pa.array((mixed(rows) % np.uint64(shards)).astype(np.int64)), pa.nulls(n, pa.binary()), *batch.columns[:3], pa.array(sizes),
                pa.array(np.bincount(of, minlength=n)), pa.array(np.bincount(of, log_p1[w[is_hot]], n).astype(np.float64))], schema=arrow)
            held.append((rows, batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8), sizes, u, v, w))
            if sum(len(h[-1]) for h in held) > FLUSH:
                yield from blocks()
        if held:
            yield from blocks()
        release()

    dealt = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`"), held, as_bytes(text_col)).mapInArrow(deal, schema)
    homes = [(v, int((mixed(np.array([v])) % np.uint64(shards))[0] + i) % shards) for v, n in enumerate(parts.tolist()) if n > 1 for i in range(n)]
    if homes:
        pairs = split_pairs(train, text_col, ids, parts).join(F.broadcast(spark.createDataFrame(homes, "v long, shard long")), "v")
        dealt = dealt.unionByName(pairs, allowMissingColumns=True)
    else:
        dealt = dealt.withColumns({k: F.lit(None).cast("long") for k in ("v", "w", "n")})

    # ``back`` is missing in a row of hot words, where ``seen`` is the logarithm of their probabilities' product.
    result = f"row long, word long, seen float, back float, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double"
    fields = to_arrow_schema(StructType.fromDDL(result))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of documents, a row for their hot words in each block, and one for each other token."""
        log_p1 = spread.value[2]
        blocks: list[bytes] = []
        listed: list[tuple] = []

        def given(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else
                                               pa.array(columns[f.name]) if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=fields)

        for batch in batches:
            blocks += [b for b in batch["block"].to_pylist() if b is not None]
            own = batch.filter(batch["row"].is_valid())
            if own.num_rows:
                yield given(own.num_rows, word=own["row"], **{k: own[k] for k in ("row", "id", "held_out", "n_tokens", "n_known", "base_score")})
            own = batch.filter(batch["v"].is_valid())
            listed.append(tuple(own[k].to_numpy() for k in ("v", "w", "n")))
        if not blocks:
            return
        for block, seen, back in shard_scores(blocks, tuple(np.concatenate(x) for x in zip(*listed))):
            word, document = block.words[block.w], np.repeat(np.arange(len(block.rows)), block.sizes)
            is_hot = word >= 0
            p = np.minimum(np.log10(seen[is_hot] + back[is_hot] * 10 ** log_p1[word[is_hot]]), 0)
            some = np.bincount(document[is_hot], minlength=len(block.rows)) > 0
            rows = block.rows[some]
            yield given(len(rows), row=rows, word=rows, seen=np.bincount(document[is_hot], p, len(block.rows))[some].astype(np.float32))
            rare = ~is_hot
            if rare.any():
                yield given(int(rare.sum()), row=block.rows[document[rare]], word=word[rare], seen=seen[rare].astype(np.float32),
                            back=back[rare].astype(np.float32))
        release()

    found = dealt.groupBy("shard").applyInArrow(score, result)
    joined = found.join(counts.select(hash_code("word").alias("word"), "n"), "word", "left")
    is_rare = F.col("back").isNotNull()
    p1 = F.log10(F.coalesce(F.col("n"), F.lit(0)) + SMOOTH) - scale
    seen, back = F.col("seen").cast("double"), F.col("back").cast("double")
    p = F.least(F.log10(seen + back * F.pow(F.lit(10.0), p1)), F.lit(0.0))
    return joined.groupBy("row").agg(
        F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(is_rare, F.col("n").isNotNull().cast("long")).otherwise(F.coalesce("n_known", F.lit(0)))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.sum(F.when(is_rare, p1).otherwise(F.coalesce("base_score", F.lit(0.0)))).alias("base_score"),
        F.sum(F.when(is_rare, p).otherwise(F.coalesce(seen, F.lit(0.0)))).alias("score")).drop("row")
