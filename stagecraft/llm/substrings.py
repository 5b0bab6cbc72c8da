"""Removal of passages that repeat anywhere in the corpus, found with an FM-index per shard.

A window is ``length`` consecutive words.  To search each window only where its equals can be, windows are
routed by their minimizer, the least hash among the short word sequences inside: equal windows have the same
one.  Neighbouring windows mostly share it, so a document falls into *runs* of windows, which overlap by
``length`` - 1 words.  A run whose minimizer stands at no second place in the corpus holds no repeated window
and goes no further.  The words of the other runs are dealt out to shards by minimizer; equal runs become one
with a number of copies.

A shard's different runs are indexed together: Burrows-Wheeler transform, wavelet matrix, rank directories.
Then the same runs are streamed through it by backward search, which ends for a window as soon as only one
place is left; windows whose matching statistic reaches ``length`` are reported as intervals.

A minimizer at very many places (a passage in a third of all documents) would gather a run from each
document in one shard, since the words around the passage differ.  Such runs are sent as single windows
instead, keyed by a hash of all of the window's words, so that only equal windows meet, however the words
between fixed ends vary.  Equality of words is decided on their bytes, not on hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from stagecraft.llm.fmindex import FMIndex
from stagecraft.llm.util import Memo, as_bytes, map_arrow
from stagecraft.runtime import store

SEED = 8             # words of a minimizer
HOT = 20_000         # places of a minimizer from which on its windows travel alone
CHUNK = 1 << 18      # words of a document looked at at a time
SHARD_BYTES = 4 << 20
FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SEED, 0, -1)], np.uint64)


def runs_of(hashes: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(minimizer, first window, last window) of each run of a document's word hashes."""
    span, step = length - SEED + 1, CHUNK - length + 1
    for at in range(0, max(0, len(hashes) - length + 1), step):
        part = hashes[at:at + CHUNK]
        n = len(part) - SEED + 1
        mixed = np.zeros(n, np.uint64)
        for k in range(SEED):
            mixed += part[k:k + n] * FACTORS[k]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        # The leftmost least among equals: the place takes the low bits.
        least = mixed & ~np.uint64(CHUNK - 1) | np.arange(n, dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
        place = (least & np.uint64(CHUNK - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        value = mixed[place[first]].view(np.int64)
        yield from zip(value.tolist(), (first + at).tolist(), (last + at).tolist())


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def document_runs(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """(minimizer, doc, first, last): the runs of every document; ``doc`` is a 64-bit hash of the text."""
    def make():
        hashed = Memo(lambda w: xxhash.xxh64_intdigest(w), 300_000)

        def step(batch):
            out: dict[str, list] = {"minimizer": [], "doc": [], "first": [], "last": []}
            for text in batch.column(0).to_pylist():
                words = text.split()
                if len(words) >= length:
                    found = list(zip(*runs_of(np.array(list(map(hashed.__getitem__, words)), np.uint64), length)))
                    out["minimizer"] += found[0]
                    out["first"] += found[1]
                    out["last"] += found[2]
                    out["doc"] += [_short(hashlib.md5(text).digest())] * len(found[0])
            yield out
        return step

    return map_arrow(docs.select(as_bytes(text_col)), make, "minimizer long, doc long, first int, last int")


def candidate_runs(runs: DataFrame) -> DataFrame:
    """(doc, runs): what each document has of runs whose minimizer stands at a second place, and whether at very many."""
    # Stored, so that the join below has shuffles of its own on both sides, which Spark can split at a hot minimizer.
    places = store(runs.groupBy("minimizer").agg(F.count(F.lit(1)).alias("places")).where("places > 1"), "places")
    return runs.join(places, "minimizer").groupBy("doc").agg(F.collect_set(
        F.struct("first", "last", "minimizer", (F.col("places") >= HOT).alias("hot"))).alias("runs"))


def sequences(docs: DataFrame, candidates: DataFrame, text_col: str, length: int) -> DataFrame:
    """(key, words, digest, first): the words of every candidate run, or of its single windows."""
    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def step(batch):
            out: dict[str, list] = {"key": [], "words": [], "digest": [], "first": []}
            size = 0
            for packed, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = unpack(packed)
                words, digest = text.split(), hashlib.md5(text).digest()
                for run in runs:
                    first, last = run["first"], min(run["last"], len(words) - length)
                    for a, b in ((k, k) for k in range(first, last + 1)) if run["hot"] else ((first, last),) if first <= last else ():
                        part = words[a:b + length]
                        joined = b" ".join(part)
                        key = xxhash.xxh64_intdigest(joined) - (1 << 63) if run["hot"] else run["minimizer"]
                        size += len(joined)
                        for name, value in zip(out, (key, joined, digest, a)):
                            out[name].append(value)
                if size > 8 << 20:
                    yield out
                    out, size = {"key": [], "words": [], "digest": [], "first": []}, 0
            yield out
        return step

    texts = packed_texts(docs, None, text_col).select("doc", "packed")
    return map_arrow(texts.join(candidates, "doc").select("packed", "runs"), make, "key long, words binary, digest binary, first int")


def packed_texts(docs: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    """(id, doc, digest, packed): texts on their way through a shuffle, compressed one by one."""
    def make():
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress

        def step(batch):
            texts = batch.column(1).to_pylist()
            digests = [hashlib.md5(t).digest() for t in texts]
            yield {"id": batch.column(0), "doc": [_short(d) for d in digests], "digest": digests, "packed": [pack(t) for t in texts]}
        return step

    kind = docs.schema[id_col].dataType.simpleString() if id_col else "long"
    key = F.col(f"`{id_col}`") if id_col else F.lit(None).cast("long")
    return map_arrow(docs.select(key.alias("id"), as_bytes(text_col)), make, f"id {kind}, doc long, digest binary, packed binary")


def repeated_windows(parts: pd.DataFrame, length: int) -> pd.DataFrame:
    """(run, first, last): ranges of repeated windows in a shard's different runs (run, words, copies)."""
    number: dict[bytes, int] = {}
    texts, starts, at = [], [], 0
    for words in parts["words"]:
        ids = [number.setdefault(w, len(number) + 1) for w in words.split(b" ")]
        texts += ids
        texts.append(0)
        starts.append(at)
        at += len(ids) + 1
    text = np.array(texts, np.int64)
    starts.append(at)
    ends = np.array(starts[1:]) - 1
    begin = np.array(starts[:-1])
    windows = ends - begin - length + 1
    owner = np.repeat(np.arange(len(parts)), windows)
    local = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    found = parts["copies"].to_numpy()[owner] > 1
    ask = np.flatnonzero(~found)
    found[ask] = FMIndex(text, length).repeated(text, begin[owner[ask]] + local[ask], length)
    owner, local = owner[found], local[found]
    if not len(owner):
        return pd.DataFrame({"run": pd.Series([], dtype=object), "from": pd.Series([], dtype="int32"), "to": pd.Series([], dtype="int32")})
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (local[1:] != local[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return pd.DataFrame({"run": parts["run"].to_numpy()[owner[first]], "from": local[first].astype(np.int32), "to": local[last].astype(np.int32)})


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 35) -> DataFrame:
    """(digest, spans): of each text (by MD5) the word ranges [from, to) covered by repeated windows."""
    if length < SEED:
        raise ValueError(f"a window has at least {SEED} words")
    runs = store(document_runs(docs, text_col, length), "runs")
    found = sequences(docs, candidate_runs(runs), text_col, length).withColumn("run", F.unhex(F.md5(F.concat(F.encode(F.col("key").cast("string"), "UTF-8"), "words"))))
    found = store(found, "sequences")
    shards = max(1, -(-(found.agg(F.sum(F.length("words"))).first()[0] or 0) // SHARD_BYTES))
    unique = found.groupBy("key", "run", "words").agg(F.count(F.lit(1)).alias("copies"))
    windows = unique.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).select("shard", "run", "words", "copies").groupBy("shard").applyInPandas(
        lambda part: repeated_windows(part, length), "run binary, from int, to int")
    places = found.select("run", "digest", "first").distinct()
    return places.join(windows, "run").groupBy("digest").agg(F.collect_set(F.struct(
        (F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to") + length).alias("to"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35) -> DataFrame:
    """(id, n_words, n_removed, kept): each document without the words of windows that repeat anywhere.

    Windows are judged on the input.  ``kept`` has the other words joined by one space.  NULL text has no
    words; texts of fewer than ``length`` words lose none; repeated rows repeat each other's windows; NULL
    ids are kept; an empty table gives an empty result; other columns are not read.
    """
    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def step(batch):
            out: dict[str, list] = {"id": [], "n_words": [], "n_removed": [], "kept": []}
            for key, packed, spans in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                words = unpack(packed).split()
                gone = np.zeros(len(words) + 1, np.int64)
                for span in spans or ():
                    gone[span["from"]] += 1
                    gone[span["to"]] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                kept = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
                for name, value in zip(out, (key, len(words), len(words) - len(kept), b" ".join(kept))):
                    out[name].append(value)
            yield out
        return step

    spans = repeated_spans(docs, text_col, length)
    texts = packed_texts(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(texts.join(spans, "digest", "left").select("id", "packed", "spans"), make,
                     f"id {kind}, n_words long, n_removed long, kept binary").withColumn("kept", F.decode("kept", "UTF-8"))
