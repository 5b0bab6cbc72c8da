"""Packing whole documents into few sequences: Martello-Toth dominance reduction, then best fit.

A packing only depends on how many pieces there are of each length, and there are fewer lengths than a sequence has
tokens.  So the instance is a histogram of bounded size, whatever the number of documents, and it is solved as a whole:

* Reduction.  For a piece of length w a set of pieces dominates if every other set that fits beside w can be exchanged
  for it without needing more sequences.  Such sets of one, two or three pieces are fixed for good, as often as both
  lengths last, and the instance shrinks; that is repeated until no set dominates.
* Best fit.  The remaining pieces go, by falling length, to the fullest sequence with room.

The plan is a list of runs: so many pieces of a length go, one each, to as many consecutive sequences, at one offset.
Pieces get their places by their rank in a total order, found without a window over a length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from stagecraft.llm.ranks import running
from stagecraft.llm.util import map_arrow
from stagecraft.llm.words import WordTokenBytes
from stagecraft.runtime import store


class Plan:
    """Runs (first rank, pieces, first sequence, offset) over a histogram; ranks count pieces by rising length."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, {w: n for w, n in counts.items() if n}
        self.lengths = sorted(self.left)  # those of which pieces are left
        self.rank, at = {}, 0
        for w in self.lengths:
            self.rank[w] = at
            at += self.left[w]
        self.runs: list[tuple[int, int, int, int]] = []
        self.sequences = 0

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, w: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((self.rank[w], n, sequence, offset))
        self.rank[w] += n
        self.left[w] -= n
        if not self.left[w]:
            del self.left[w]
            del self.lengths[bisect.bisect_left(self.lengths, w)]

    # Reduction

    def smallest(self, n: int, beside: int) -> list[int]:
        """The n least pieces, one of length ``beside`` aside."""
        out: list[int] = []
        for w in self.lengths:
            out += [w] * min(n - len(out), self.left[w] - (w == beside))
            if len(out) == n:
                break
        return out

    def largest(self, room: int, beside: int) -> int:
        """The greatest piece that fits, one of length ``beside`` aside; 0 if there is none."""
        at = bisect.bisect_right(self.lengths, room) - 1
        if at >= 0 and self.lengths[at] == beside and self.left[beside] == 1:
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def best_pair(self, room: int, beside: int) -> tuple[int, int]:
        """The two pieces of the greatest sum that fits, the greater first; of equal sums the one with the greatest piece."""
        best, low, high = (0, 0), 0, bisect.bisect_right(self.lengths, room) - 1
        free = lambda w: self.left[w] - (w == beside)
        while low <= high:
            a, b = self.lengths[high], self.lengths[low]
            if a + b > room or not free(a):
                high -= 1
            elif not free(b) or (a == b and free(a) < 2):
                low += 1
            else:
                if a + b > sum(best):
                    best = a, b
                low += 1
        return best

    def dominating(self, w: int) -> tuple[int, ...] | None:
        """A set with w that dominates all sets with w, if one of at most three pieces is known to."""
        room = self.capacity - w
        least = self.smallest(3, w)
        fits = sum(sum(least[:k + 1]) <= room for k in range(len(least)))  # how many others fit at most, told up to 3
        if fits == 0:
            return (w,)
        one = self.largest(room, w)
        # Alone with w, or without waste, the greatest piece stands for any others.
        if fits == 1 or one == room:
            return w, one
        if fits == 2:
            a, b = self.best_pair(room, w)
            if one >= a + b:
                return w, one
            if a == one and self._none_above(b, room, w):
                return w, a, b
        return None

    def _none_above(self, b: int, room: int, beside: int) -> bool:
        """Whether no two pieces fit that are both greater than b: then every pair fits into the places of (one, b)."""
        two: list[int] = []
        for w in self.lengths[bisect.bisect_right(self.lengths, b):]:
            two += [w] * min(2 - len(two), self.left[w] - (w == beside))
            if len(two) == 2:
                return sum(two) > room
        return True

    def reduce(self) -> None:
        """Fix dominating sets, from the greatest length on, until none is found."""
        fixed = True
        while fixed:
            fixed = False
            for w in self.lengths[::-1]:
                while w in self.left and (found := self.dominating(w)):
                    need = Counter(found)
                    times = min(self.left[x] // n for x, n in need.items())
                    first, offset = self.open(times), 0
                    for x in found:
                        self.put(x, times, first, offset)
                        offset += x
                    fixed = True

    # Best fit

    def best_fit(self) -> None:
        """Place what is left by falling length; a run of sequences filled alike is one entry."""
        rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)
        known: list[int] = []

        def keep(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in rooms:
                    rooms[room] = []
                    bisect.insort(known, room)
                rooms[room].append((first, n))

        for w in self.lengths[::-1]:
            while w in self.left:
                at = bisect.bisect_left(known, w)
                if at < len(known):
                    room = known[at]
                    first, n = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room], known[at]
                    taken = min(n, self.left[w])
                    self.put(w, taken, first, self.capacity - room)
                    keep(room - w, first, taken)
                    keep(room, first + taken, n - taken)
                else:
                    each = self.capacity // w
                    n, rest = divmod(self.left[w], each)
                    first = self.open(n + bool(rest))
                    for k in range(each if n else 0):
                        self.put(w, n, first, k * w)
                    for k in range(rest):
                        self.put(w, 1, first + n, k * w)
                    keep(self.capacity - each * w, first, n)
                    keep(self.capacity - rest * w, first + n, bool(rest))


def planned(counts: dict[int, int], capacity: int) -> Plan:
    plan = Plan(counts, capacity)
    plan.reduce()
    plan.best_fit()
    return plan


def word_pieces(docs: DataFrame, id_col: str, text_col: str, length: int, end_id: int, tokenizer: str) -> DataFrame:
    """(id, row, piece, start, length, crc), one row per piece of at most ``length`` tokens, stored."""
    with open(tokenizer, "rb") as file:  # a vocabulary file, on the driver
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())

    def make():
        encode, end = WordTokenBytes(vocabulary.value), np.array([end_id], "<u4").tobytes()

        def step(batch):
            out: dict[str, list] = {k: [] for k in ("id", "row", "piece", "start", "length", "crc")}
            for key, row, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                ids = encode(text) + end
                for piece, start in enumerate(range(0, len(ids) // 4, length)):
                    part = ids[4 * start:4 * (start + length)]
                    for k, v in zip(out, (key, row, piece, start, len(part) // 4, zlib.crc32(part))):
                        out[k].append(v)
            yield out
        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return store(map_arrow(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"),
                    F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")),
        make, f"id {kind}, row long, piece int, start long, length long, crc long"), "pieces")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 0,
         tokenizer: str | None = None) -> DataFrame:
    """(id, row, piece, start, length, crc, sequence_id, offset), one row per piece.

    A document's stream is its ids and then ``end_id``, so NULL and empty texts are one token long.  Documents longer than
    ``length`` are cut into pieces of that length and a rest; no other document is cut.  ``row`` tells repeated ids apart:
    rows with equal or NULL ids are packed each on their own.  Ties in length are taken in the order of rows, so reruns
    over the same files agree.  An empty table gives an empty result, and other columns are not read.

    To the driver goes the histogram of the lengths, fewer than ``length`` numbers; back goes the plan, whose size depends
    on the lengths that occur and not on the documents.
    """
    pieces = word_pieces(docs, id_col, text_col, length, end_id, tokenizer or default_tokenizer())
    short = pieces.where(F.col("length") < length)
    counts = dict(map(tuple, short.groupBy("length").count().collect()))
    plan = planned(counts, length)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 4)
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    columns = ["id", "row", "piece", "start", "length", "crc"]

    def make():
        first, _, sequence, offset = shared.value.T

        def step(batch):
            rank = batch.column(len(columns)).to_numpy()
            at = np.searchsorted(first, rank, "right") - 1
            yield {**{c: batch.column(i) for i, c in enumerate(columns)},
                   "sequence_id": sequence[at] + rank - first[at], "offset": offset[at]}
        return step

    ranked = running(short, [F.col("length"), F.col("row"), F.col("piece")])
    kind = pieces.schema["id"].dataType.simpleString()
    packed = map_arrow(ranked.select(*columns, "rank"), make,
                       f"id {kind}, row long, piece int, start long, length long, crc long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == length).select(
        *columns, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
