"""Packing token streams into sequences: first-fit decreasing over a tournament tree of bins.

Each document's token ids are cut at multiples of the sequence length; a full piece is a sequence of its
own.  The rests are packed independently in randomised groups of documents: in order of falling length,
each goes to the first bin with room, found by descending a tournament tree whose inner nodes hold the
greatest free capacity below.  Bins that stay emptier than ``spare`` are opened again: their pieces are cut
at powers of two, and such parts, laid out by falling length, fill whole sequences without gaps; what is
left fills sequences whose length is a power of two.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from stagecraft.llm.util import Memo, as_bytes, map_arrow, release
from stagecraft.runtime import store


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(tokenizer_json: bytes) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level BPE file; its alphabet shows each byte as a printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    data = json.loads(tokenizer_json)
    special = {t["content"] for t in data.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}


def added_ids(tokenizer_json: bytes) -> dict[str, int]:
    """Content -> id of the tokens that a file adds to its vocabulary."""
    added = json.loads(tokenizer_json).get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take blanks or stand by themselves are not supported")
    return {t["content"]: t["id"] for t in added}


class TokenBytes:
    """A text's token ids as little-endian 32-bit numbers.

    With ``added`` the file's added tokens are taken out of the text first and get their own ids, as
    ``tokenizers`` does by default (leftmost, of several the longest); otherwise they are ordinary text.

    A text is cut at each single blank between two characters that are not white space: the
    tokenizer's pattern never matches across such a place, so the parts (a blank and what follows) have
    ids of their own, which are remembered for up to ``limit`` different parts.
    """

    CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, tokenizer_json: bytes, limit: int = 100_000, added: bool = False) -> None:
        import public_tokenizers
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                          mergeable_ranks=byte_ranks(tokenizer_json))
        encoding = self.encoding

        # Not methods: a memo that refers to its owner outlives the task until the worker happens to collect its garbage.
        def encode(text: str) -> bytes:
            return np.array(encoding.encode_ordinary(text), "<u4").tobytes()

        def part(part: str) -> bytes | None:
            """None for a part beside which no cut is allowed."""
            return None if not part or part[0].isspace() or part[-1].isspace() else encode(" " + part)

        self._encode, self.known = encode, Memo(part, limit)
        found = added_ids(tokenizer_json) if added else {}
        self.added = {content: np.array([i], "<u4").tobytes() for content, i in found.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")") if found else None

    def __call__(self, text: str) -> bytes:
        parts = self.split.split(text) if self.split else [text]
        if len(parts) == 1:
            return self._ordinary(text)
        return b"".join([self.added[p] if i % 2 else self._ordinary(p) for i, p in enumerate(parts)])

    def _ordinary(self, text: str) -> bytes:
        first, *parts = text.split(" ")
        if not parts:
            return self._encode(text)
        parts = list(map(self.known.__getitem__, parts))
        if None in parts or not first or first[-1].isspace():
            first, *parts = self.CUT.split(text)
            parts = [self._encode(" " + p) for p in parts]
        return self._encode(first) + b"".join(parts)


def powers(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, length: int, end_id: int, tokenizer: str, added: bool = False) -> DataFrame:
    """(id, row, doc_tokens, start, length, crc, part_crcs), one row per piece, stored.

    ``part_crcs`` has the checksums of a short piece's parts, cut at powers of two by falling size.
    """
    with open(tokenizer, "rb") as file:  # a vocabulary file, on the driver
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())

    def make():
        encode, end = TokenBytes(vocabulary.value, added=added), np.array([end_id], "<u4").tobytes()

        def step(batch):
            out: dict[str, list] = {k: [] for k in ("id", "row", "doc_tokens", "start", "length", "crc", "part_crcs")}
            for key, row, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                ids = encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start:4 * (start + length)]
                    sums, at = [], 0
                    for size in powers(len(piece) // 4) if len(piece) < 4 * length else ():
                        sums.append(zlib.crc32(piece[at:at + 4 * size]))
                        at += 4 * size
                    for k, v in zip(out, (key, row, n, start, len(piece) // 4, zlib.crc32(piece), sums)):
                        out[k].append(v)
            yield out
        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return store(map_arrow(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"),
                    F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")),
        make, f"id {kind}, row long, doc_tokens long, start long, length long, crc long, part_crcs array<long>"), "pieces")


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item; items come in falling order.  The tree's leaves are bins, open from left to right."""
    size = 1
    while size < len(lengths):
        size *= 2
    free = [capacity] * (2 * size)
    bins = []
    for n in lengths:
        node = 1
        while node < size:
            node *= 2
            if free[node] < n:
                node += 1
        bins.append(node - size)
        free[node] -= n
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins


def pack_group(lengths: list[int], capacity: int, spare: int) -> list[tuple[int, int, int, int, int]]:
    """(item, part start, part length, sequence, offset): one group's pieces, all shorter than ``capacity``.

    Whole pieces have the start 0 and their whole length.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins = dict(zip(order, first_fit([lengths[i] for i in order], capacity)))
    filled: dict[int, int] = {}
    for i, b in bins.items():
        filled[b] = filled.get(b, 0) + lengths[i]
    tight = {b for b, n in filled.items() if capacity - n <= spare}
    names: dict[int, int] = {}
    at: dict[int, int] = {}
    out, parts = [], []
    for i in order:
        b = bins[i]
        if b in tight:
            out.append((i, 0, lengths[i], names.setdefault(b, len(names)), at.get(b, 0)))
            at[b] = at.get(b, 0) + lengths[i]
        else:
            start = 0
            for n in powers(lengths[i]):
                parts.append((n, i, start))
                start += n
    # Falling powers of two meet every multiple of the capacity, and then every power in the rest.
    parts.sort(key=lambda p: (-p[0], p[1], p[2]))
    total, sequence = sum(p[0] for p in parts), len(names)
    rooms = iter([capacity] * (total // capacity) + powers(total % capacity))
    room = used = 0
    for n, i, start in parts:
        if used == room:
            room, used, sequence = next(rooms), 0, sequence + 1
        out.append((i, start, n, sequence - 1, used))
        used += n
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0,
         tokenizer: str | None = None, group_docs: int = 4096, spare: int = 64, seed: int = 7, added: bool = False) -> DataFrame:
    """(id, row, start, length, crc, doc_tokens, sequence_id, offset), one row per piece.

    A document's stream is its ids and then ``end_id``, so NULL and empty texts are one token long.  ``length``
    is a power of two.  With ``added`` the tokens that the file adds (``<|endoftext|>``) get their own ids, otherwise
    they are ordinary text.  ``row`` tells repeated ids apart.  Groups are drawn by a seeded hash of the row and hold
    ``group_docs`` documents on average, whatever their sources or texts.  An empty table gives an empty
    result; other columns are not read.
    """
    if length & (length - 1):
        raise ValueError("the sequence length is a power of two")
    pieces = token_pieces(docs, id_col, text_col, length, end_id, tokenizer or default_tokenizer(), added)
    short = pieces.where(F.col("length") < length)
    groups = max(1, round(short.count() / group_docs))
    columns = ["id", "row", "start", "length", "crc", "doc_tokens"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["row", "start"], ignore_index=True)  # the same packing at any arrival order
        packed = pack_group(part["length"].tolist(), length, spare)
        item, start, size, sequence, offset = (np.array(x, np.int64) for x in zip(*packed))
        out = part.iloc[item][columns].reset_index(drop=True)
        whole = size == out["length"].to_numpy()
        sums = part["part_crcs"].tolist()
        nth: dict[int, dict[int, int]] = {}
        for i in set(item[~whole].tolist()):
            at, nth[i] = 0, {}
            for n, crc in zip(powers(int(part["length"][i])), sums[i]):
                nth[i][at] = crc
                at += n
        out["crc"] = [c if w else nth[i][s] for c, w, i, s in zip(out["crc"], whole, item.tolist(), start.tolist())]
        out["start"] += start
        out["length"], out["offset"] = size, offset
        out["sequence_id"] = (int(part["group"].iloc[0]) << 32) + sequence
        release()
        return out[[*columns, "sequence_id", "offset"]]

    kind = pieces.schema["id"].dataType.simpleString()
    packed = short.withColumn("group", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups))).groupBy("group").applyInPandas(
        run, f"id {kind}, row long, start long, length long, crc long, doc_tokens long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == length).select(
        *columns, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
