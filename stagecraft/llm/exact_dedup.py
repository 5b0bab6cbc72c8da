"""Exact deduplication with static binary-fuse filters over immutable snapshots.

Documents arrive in batches.  What is known so far is an immutable *snapshot*: one row per different
text (its 32-byte digest and byte length), cut into shards by digest.  Each shard carries a static
binary-fuse filter (three hash positions in neighbouring segments, 8-bit fingerprints, about 9 bits per
key).  An incoming batch is first reduced to its own different digests, so duplicates inside the batch
are grouped by themselves; the filter of the shard then screens them.  A negative answer is certain: that
digest is new and never meets the snapshot.  Positives are joined with the exact buckets, where all 32
bytes of the digest and the byte length must agree.

Texts themselves are read once, to be hashed, and never shuffled: SHA-256 over the whole normalised text
with its length stands for the bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stagecraft.llm.util import as_bytes, free_names, map_arrow
from stagecraft.runtime import store

ARITY = 3
SCREENED = 50_000_000  # keys of the filters that go to every task, 9 bits each


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over uint64 keys."""
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


@dataclass
class FuseFilter:
    """A static set of 64-bit keys: no false negatives, false positives once in 256."""

    seed: int
    segment: int
    segments: int
    table: np.ndarray

    def _slots(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.segment - 1)
        base = ((h >> np.uint64(32)) * np.uint64(self.segments * self.segment)) >> np.uint64(32)
        one = (base + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        two = (base + np.uint64(2 * self.segment)) ^ (h & mask)
        return np.stack([base, one, two]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peel keys that are alone in a slot, round by round, then fill the table backwards."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        slots_wanted = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 32
        segments = max(1, -(-slots_wanted // segment) - ARITY + 1)
        for seed in range(1, 1000):
            new = cls(seed, segment, segments, np.zeros((segments + ARITY - 1) * segment, np.uint8))
            h = _mixed(keys, seed)
            rounds = new._peel(new._slots(h), n)
            if rounds is not None:
                prints, slots = cls._print(h), new._slots(h)
                for which, at in reversed(rounds):
                    value = prints[which].copy()
                    for k in range(ARITY):
                        value ^= new.table[slots[k, which]]
                    new.table[at] ^= value
                return new
        raise RuntimeError("no seed peels this set")

    def _peel(self, slots: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        count = np.bincount(slots.ravel(), minlength=len(self.table))
        owner = np.zeros(len(self.table), np.int64)  # xor of the positions of the keys in a slot
        for k in range(ARITY):
            np.bitwise_xor.at(owner, slots[k], np.arange(n))
        rounds, left = [], n
        while left:
            alone = np.flatnonzero(count == 1)
            which, first = np.unique(owner[alone], return_index=True)
            if not len(which):
                return None
            rounds.append((which, alone[first]))
            left -= len(which)
            for k in range(ARITY):
                np.subtract.at(count, slots[k, which], 1)
                np.bitwise_xor.at(owner, slots[k, which], which)
        return rounds

    def holds(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(keys.astype(np.uint64), self.seed)
        slots = self._slots(h)
        return self._print(h) == self.table[slots[0]] ^ self.table[slots[1]] ^ self.table[slots[2]]

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<i8").tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> FuseFilter:
        seed, segment, segments = np.frombuffer(data, "<i8", 3).tolist()
        return cls(seed, segment, segments, np.frombuffer(data, np.uint8, offset=24))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, digest, n_bytes) of each document, stored: ``row`` tells repeated ids apart.

    The text is lower-cased in A-Z only; NULL counts as empty.
    """
    def make():
        def step(batch):
            texts = [t.lower() for t in batch.column(2).to_pylist()]
            yield {"id": batch.column(0), "row": batch.column(1),
                   "digest": [hashlib.sha256(t).digest() for t in texts], "n_bytes": [len(t) for t in texts]}
        return step

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), as_bytes(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    return store(map_arrow(rows, make, f"id {kind}, row long, digest binary, n_bytes long"), "digests")


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per different text: its size and the row that stays (largest id, then largest row)."""
    return rows.groupBy("digest", "n_bytes").agg(
        F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("size"))


def with_shard(groups: DataFrame, shards: int) -> DataFrame:
    """The 64-bit filter key and the shard, both from the digest."""
    key = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    return groups.withColumn("key", key).withColumn("shard", F.pmod(F.hash("key"), F.lit(shards)))


def build_filters(snapshot: DataFrame) -> DataFrame:
    """(shard, filter) of a snapshot that has ``shard`` and ``key``; a shard is one bounded group."""
    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = FuseFilter.build(part["key"].to_numpy())
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "filter": [made.to_bytes()]})

    return snapshot.select("shard", "key").groupBy("shard").applyInPandas(build, "shard int, filter binary")


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """Add ``maybe`` to a batch's groups: False is certain, True has to meet the exact bucket."""
    def check(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = part[["digest"]].copy()
        if len(known) and len(part):
            out["maybe"] = FuseFilter.from_bytes(known["filter"].iloc[0]).holds(part["key"].to_numpy())
        else:
            out["maybe"] = False
        return out

    flags = batch.select("digest", "key", "shard").groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(
        check, "digest binary, maybe boolean")
    return batch.drop("key", "shard").join(flags, "digest")


def add_batch(snapshot: DataFrame, batch: DataFrame, shard_keys: int = 200_000) -> DataFrame:
    """The groups of a snapshot and of a batch together.

    Both sides are results of ``groups_of``.  ``shard_keys`` bounds the different digests per shard on
    average; their number, not a row count of one hot text, sets the shards.
    """
    shards = max(1, -(-max(snapshot.count(), batch.count()) // shard_keys))
    known = snapshot.withColumnRenamed("keep", "known_keep").withColumnRenamed("size", "known_size")
    screened = store(screen(with_shard(batch, shards), build_filters(with_shard(snapshot, shards))), "screened")
    maybe = screened.where("maybe").drop("maybe")
    same = ["digest", "n_bytes"]
    grown = known.join(maybe, same, "left").select(
        *same, F.greatest("known_keep", "keep").alias("keep"),
        (F.col("known_size") + F.coalesce("size", F.lit(0))).alias("size"))
    return grown.unionByName(maybe.join(known.select(*same), same, "left_anti")).unionByName(
        screened.where("not maybe").drop("maybe"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = 200_000) -> DataFrame:
    """Each document with its group of equal texts.

    The table is taken as a snapshot (half of the rows, by a hash of the row) and one incoming batch.
    Returns (id, row, digest, keep_id, keep_row, group_size, kept), one row per document.  Of repeated
    rows, ids included, exactly one is kept; NULL ids sort first; NULL text equals empty text; an empty
    table gives an empty result.  Other columns, whatever their names, are not read.
    """
    rows = digests(docs, id_col, text_col)
    late = F.pmod(F.xxhash64("row"), F.lit(2)) == 1
    snapshot = store(groups_of(rows.where(~late)), "snapshot")
    batch = store(groups_of(rows.where(late)), "batch")
    shared = add_batch(snapshot, batch, shard_keys).where("size > 1")
    return rows.join(shared, ["digest", "n_bytes"], "left").select(
        "id", "row", "digest",
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce(F.col("keep.row"), F.col("row")).alias("keep_row"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce(F.col("keep.row"), F.col("row")) == F.col("row")).alias("kept"))


def digest_column(text_col: str) -> Column:
    """The digest of a text as ``digests`` takes it."""
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.sha256(t.lower()).digest())

    return run(as_bytes(text_col))


class Screen:
    """Whether a key can be in a set: False is certain.

    A binary-fuse filter for each shard of the set.  Keys are 64-bit hashes; the filters take 9 bits a key and go to every
    task while there are at most ``SCREENED`` keys; beyond that every key may be in it.
    """

    def __init__(self, keys: DataFrame, shard_keys: int = 200_000) -> None:
        """``keys`` has one column ``key``, a long."""
        n = keys.count()
        self.all, self.shards, self.shared = n > SCREENED, max(1, -(-n // shard_keys)), None
        if not self.all:
            found = build_filters(keys.withColumn("shard", F.pmod("key", F.lit(self.shards)).cast("int"))).collect()
            self.shared = keys.sparkSession.sparkContext.broadcast({r["shard"]: r["filter"] for r in found})

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Inside a task."""
        if self.all:
            return np.ones(len(keys), bool)
        out, shard = np.zeros(len(keys), bool), keys % self.shards
        for s in np.unique(shard).tolist():
            if s in self.shared.value:
                at = shard == s
                out[at] = FuseFilter.from_bytes(self.shared.value[s]).holds(keys[at])
        return out

    def column(self, key: Column) -> Column:
        if self.all:
            return F.lit(True)
        screen = self

        @F.pandas_udf("boolean")
        def maybe(keys: pd.Series) -> pd.Series:
            return pd.Series(screen.holds(keys.to_numpy()))

        return maybe(key)


def screen_column(dropped: DataFrame, id_col: str, own: str, known: str, digest: str, shard_keys: int) -> Column:
    """Whether a document can be among the dropped rows, by (id, digest): False is certain."""
    def key_of(id_column: str, digest_column: str) -> Column:
        return F.xxhash64(F.col(f"`{id_column}`"), F.col(digest_column))

    return Screen(dropped.select(key_of(known, digest).alias("key")), shard_keys).column(key_of(id_col, own))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = 200_000) -> DataFrame:
    """The documents that stay, with all their columns.

    A binary-fuse filter of the rows to drop, by id and digest, lets all others pass where they are; only rows that it
    holds are joined with the list (NULL ids meet NULL ids).  Rows equal in id and text are told apart by nothing, so one
    of them is taken.  NULL counts as empty text, an empty table gives an empty result, very long texts are hashed whole,
    and other columns, whatever their names, go along unread.
    """
    groups = exact_groups(docs, id_col, text_col)
    names = free_names(docs, "id", "digest", "stay", "of", "own", "maybe")
    stay = F.sum(F.col("kept").cast("int"))
    drop = store(groups.groupBy(F.col("id").alias(names["id"]), F.col("digest").alias(names["digest"])).agg(
        stay.alias(names["stay"]), F.count(F.lit(1)).alias(names["of"])).where(f"{names['stay']} < {names['of']}"), "drop")
    maybe = screen_column(drop, id_col, names["own"], names["id"], names["digest"], shard_keys)
    screened = docs.withColumn(names["own"], digest_column(text_col)).withColumn(names["maybe"], maybe)
    # Always by a merge join: what is dropped grows with the input and fits no broadcast for long.
    marked = screened.where(F.col(names["maybe"])).join(
        drop.hint("merge"), F.col(f"`{id_col}`").eqNullSafe(F.col(names["id"])) & (F.col(names["own"]) == F.col(names["digest"])), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = screened.where(~F.col(names["maybe"])).select(*columns).unionByName(marked.where(f"{names['stay']} is null").select(*columns))
    one = drop.where(f"{names['stay']} > 0")
    if not one.isEmpty():
        out = out.unionByName(marked.where(f"{names['stay']} > 0").dropDuplicates([names["id"], names["digest"]]).select(*columns))
    return out
