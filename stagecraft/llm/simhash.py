"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has a bit for the majority among the hashes of its word shingles.  To find all
fingerprints within a Hamming radius r, each bit position gets a non-zero vector of r + 1 bits; for every
non-zero vector v there is a table, whose mask leaves out the positions with odd inner product with v.
Two fingerprints that differ in at most r bits differ at positions whose vectors span at most r of the
r + 1 dimensions, so some v is orthogonal to all of them, and in that table both have the same masked
value: no pair within the radius is missed.  With r = 2 there are seven tables of 64-bit masks, each with
27 to 28 kept bits or more.

Inside a table, fingerprints that share a masked value differ only where the mask is open.  They are not
compared in pairs: two values are within two bits exactly if one of their neighbours (the value itself or
one open bit flipped) is common, so each value is sent to its neighbours and linked with the least value
that meets it there.  Only values that share a bucket take part in that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from stagecraft.llm.exact_dedup import Screen
from stagecraft.llm.graph import connected_components
from stagecraft.llm.util import as_bytes, free_names, map_arrow
from stagecraft.runtime import store

BITS = 64
CHUNK = 1 << 16  # shingles hashed at a time, so that a very long text needs bounded memory


def masks(radius: int = 2) -> list[int]:
    """The kept bits of each table (unsigned)."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(BITS)]
    return [sum(1 << i for i, v in enumerate(vectors) if not (v & t).bit_count() & 1) for t in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles; 0 for a text without words; the whole text if it has fewer words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    n = max(1, len(parts) - words + 1)
    last = stops[min(words, len(parts)) - 1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:min(at + CHUNK, n)], last[at:at + CHUNK])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint_column(text_col: str, words: int = 3) -> Column:
    """The fingerprint as a (signed) long."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: signed(fingerprint(t, words))).astype("int64")

    return run(as_bytes(text_col))


def near_links(values: DataFrame, column: str = "fingerprint", radius: int = 2) -> DataFrame:
    """(u, v) links among different fingerprints; their closure joins exactly the values within the radius.

    Every link joins two values at most ``radius`` bits apart, and any two such values are connected by links.
    """
    if radius != 2:
        raise ValueError("the neighbour step is for radius 2")
    tables = masks(radius)
    keyed = values.select(F.col(column).alias("f"), F.posexplode(F.array(*[
        F.col(column).bitwiseAND(F.lit(signed(m))) for m in tables])).alias("t", "k"))
    buckets = keyed.groupBy("t", "k").agg(F.min("f").alias("low"), F.max("f").alias("high")).where("low < high")
    shared = keyed.join(buckets.select("t", "k"), ["t", "k"])
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in tables])
    hubs = shared.select("t", "f", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip")).select(
        "t", "f", F.col("f").bitwiseXOR(F.col("flip")).alias("hub"))
    least = hubs.groupBy("t", "hub").agg(F.min("f").alias("v"), F.max("f").alias("w")).where("v < w").drop("w")
    return hubs.join(least, ["t", "hub"]).where("f <> v").select(F.col("f").alias("u"), "v").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint long, component_id): each document and the least id of its group.

    Groups are the connected components of "fingerprints differ in at most ``radius`` bits"; texts without
    words (NULL, empty, blank) have fingerprint 0 and link like any other.  NULL ids are least only where a
    group has no other id.  Repeated rows give repeated rows, an empty table an empty one, and other columns
    are not read.
    """
    return rooted_groups(docs, id_col, text_col, words, radius).drop("root")


def rooted_groups(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id, root): as ``near_groups``, with the group's least fingerprint, which names it."""
    def make():
        def step(batch):
            yield {"id": batch.column(0), "fingerprint": [signed(fingerprint(t, words)) for t in batch.column(1).to_pylist()]}
        return step

    kind = docs.schema[id_col].dataType.simpleString()
    rows = store(map_arrow(docs.select(F.col(f"`{id_col}`").alias("id"), as_bytes(text_col)), make,
                           f"id {kind}, fingerprint long"), "fingerprints")
    values = store(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "values")
    nodes = connected_components(near_links(values, "fingerprint", radius))
    return rows.join(named_groups(values, nodes, "fingerprint"), "fingerprint").select("id", "fingerprint", "component_id", "root")


def named_groups(values: DataFrame, nodes: DataFrame, mark: str) -> DataFrame:
    """(mark, component_id, root) of every value (mark, least id), also of those that no link reaches."""
    roots = values.join(nodes.withColumnRenamed("node", mark), mark)
    least = roots.groupBy("root").agg(F.min("least").alias("linked"))
    linked = store(roots.join(least, "root").select(mark, "linked", "root"), "linked")
    # A linked group without any id has a NULL of its own: its values' least ids are NULL too.
    return values.join(linked, mark, "left").select(
        mark, F.coalesce("linked", "least").alias("component_id"), F.coalesce("root", mark).alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id, with all its columns.

    A row without an id stays only where its whole group has none.  Ids held by several rows are decided
    by fingerprint, and of several rows with a group's least id one stays.
    """
    groups = store(rooted_groups(docs, id_col, text_col, words), "groups")
    return one_of_each(docs, groups, "fingerprint", fingerprint_column(text_col, words), id_col)


def one_of_each(docs: DataFrame, groups: DataFrame, mark: str, mark_of: Column, id_col: str) -> DataFrame:
    """The documents that have their group's least id, one of each ``root``.

    ``groups`` is (id, mark, component_id, root) of every row, and ``mark_of`` gives a document's mark.
    """
    names = free_names(docs, "id", "mark", "least", "root", "maybe")
    keep = F.col("id").eqNullSafe(F.col("component_id"))
    ids = groups.groupBy(F.col("id").alias(names["id"])).agg(F.count(F.lit(1)).alias("n"), F.max(keep).alias("keep"))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(names["id"]))
    # A filter of the ids to drop lets all others pass where they are; only what it holds is shuffled.
    gone = store(ids.where("n > 1 or not keep").select(names["id"]), "gone")
    maybe = Screen(gone.select(F.xxhash64(names["id"]).alias("key"))).column(F.xxhash64(F.col(f"`{id_col}`")))
    screened = docs.withColumn(names["maybe"], maybe)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = screened.where(~F.col(names["maybe"])).select(*columns).unionByName(
        screened.where(F.col(names["maybe"])).join(gone, same, "left_anti").select(*columns))
    repeated = ids.where("n > 1").select(names["id"])
    if not repeated.isEmpty():
        roots = groups.where(keep).select(F.col(mark).alias(names["mark"]), F.col("component_id").alias(names["least"]),
                                          F.col("root").alias(names["root"])).distinct()
        again = docs.join(repeated, same, "left_semi").withColumn(names["mark"], mark_of)
        again = again.join(roots, names["mark"]).where(F.col(f"`{id_col}`").eqNullSafe(F.col(names["least"])))
        # By the group, not by its least id: unrelated groups may share one, or have none.
        kept = kept.unionByName(again.dropDuplicates([names["root"]]).select(*columns))
    return kept
