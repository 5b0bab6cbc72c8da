"""Exact top-k by inner product over norm-sorted vectors.

Candidates are dealt out to stripes, queries to chunks, and every chunk meets every stripe as one bounded
group.  Inside a group the vectors are rotated into the singular directions of the stripe, so that the
leading coordinates carry most of every product, and candidates are taken in blocks of falling length.  Two
Cauchy-Schwarz bounds prune against the query's k-th best score so far: a block whose longest vector times
the query's length cannot reach it ends the search of that query, since all later blocks are shorter; and a
candidate is only looked at in full if the partial product of the leading coordinates plus the product of
the residual lengths can reach it.  Scores themselves are exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stagecraft.runtime import store

STRIPE, CHUNK = 8192, 4096   # candidates and queries of one group
BLOCK, QUERY_BLOCK = 1024, 512
LAST_ID = 2**63 - 1


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(row, id, no_id, dim, vec) with floor(scale * x) as 64-bit integers, stored.

    Vectors that are NULL or hold NULL or non-finite components are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, vecs, dims = [], [], []
            for i, v in enumerate(batch.column(3).to_pylist()):
                if v is None or None in v:
                    continue
                x = np.asarray(v, np.float64) * scale
                if not np.isfinite(np.asarray(v, np.float64)).all():
                    continue
                if len(x) and np.abs(x).max() >= 2**62:
                    raise OverflowError("a component does not fit 64 bits")
                keep.append(i)
                vecs.append(np.floor(x).astype("<i8").tobytes())
                dims.append(len(x))
            kept = batch.select([0, 1, 2]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())],
                                             names=["row", "id", "no_id", "dim", "vec"])

    key = F.col(f"`{id_col}`").cast("long")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.coalesce(key, F.lit(LAST_ID)).alias("id"),
                          key.isNull().alias("no_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    return store(rows.mapInArrow(run, "row long, id long, no_id boolean, dim int, vec binary"), "vectors")


def _matrix(part: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(part["vec"]), "<i8").reshape(len(part), int(part["dim"].iloc[0]))


def search(c: np.ndarray, c_row: np.ndarray, c_id: np.ndarray, q: np.ndarray, q_row: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query position, candidate position, score) of each query's k best candidates other than its own row."""
    dim = c.shape[1]
    largest = max(1, int(np.abs(c).max(initial=0))) * max(1, int(np.abs(q).max(initial=0))) * max(1, dim)
    if largest >= 2**63:
        raise OverflowError("a score does not fit 64 bits")
    exact = np.float64 if largest < 2**53 else np.int64
    cf, qf = c.astype(np.float64), q.astype(np.float64)
    turn = np.linalg.eigh(cf.T @ cf)[1][:, ::-1]
    cf, qf, head = cf @ turn, qf @ turn, max(1, dim // 4)
    c_len, q_len = np.sqrt((cf**2).sum(1)), np.sqrt((qf**2).sum(1))
    order = np.lexsort((c_id, -c_len))
    c_rest, q_rest = np.sqrt((cf[:, head:] ** 2).sum(1)), np.sqrt((qf[:, head:] ** 2).sum(1))
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(q), QUERY_BLOCK):
        qs = np.arange(at, min(at + QUERY_BLOCK, len(q)))
        best = np.full(len(qs), -np.inf)  # the k-th best score so far
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for lo in range(0, len(order), BLOCK):
            block = order[lo:lo + BLOCK]
            slack = 1e-9 * q_len[qs] * c_len[block[0]] + 1e-6
            live = np.flatnonzero(q_len[qs] * c_len[block[0]] + slack >= best)
            if not len(live):
                break
            part = qf[qs[live], :head] @ cf[block, :head].T
            part += q_rest[qs[live], None] * c_rest[block] + slack[live, None]
            near = part >= best[live, None]
            if near.mean() > 0.1:
                scores = q[qs[live]].astype(exact) @ c[block].astype(exact).T
                near &= scores >= best[live, None]
                i, j = np.nonzero(near)
                s = scores[i, j].astype(np.int64)
            else:
                i, j = np.nonzero(near)
                s = (q[qs[live[i]]] * c[block[j]]).sum(1)
            i, j = live[i], block[j]
            other = c_row[j] != q_row[qs[i]]
            i, j, s = (np.concatenate([a, b[other]]) for a, b in zip(held, (i, j, s)))
            by = np.lexsort((c_id[j], -s, i))
            i, j, s = i[by], j[by], s[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            top = place < k
            held = i[top], j[top], s[top]
            kth = place == k - 1
            best[i[kth]] = s[kth]
        found.append((qs[held[0]], held[1], held[2]))
    return tuple(np.concatenate(x) for x in zip(*found))


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
                scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, all if there are fewer.

    ``is_query`` is a condition on the columns ``id`` and ``no_id``.  Candidates are all rows but the query's own
    (a second row with the same id is a candidate); ties go to the smaller id, NULL ids last, then to the
    earlier row.  Only vectors of the same length have a product; those that are NULL or hold NULL or
    non-finite components take no part; repeated rows count each time; an empty table gives an empty result.
    Scores beyond 64 bits raise an error.
    """
    known = quantised(vectors, id_col, vec_col, scale)
    chosen = known.where(~F.col("no_id") & is_query)
    stripes, chunks = max(1, -(-known.count() // STRIPE)), max(1, -(-chosen.count() // CHUNK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = known.withColumns({"stripe": F.pmod(F.xxhash64("row"), F.lit(stripes)).cast("int"), "chunk": every(chunks)})
    right = chosen.withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int")).withColumn("stripe", every(stripes))

    def run(cand: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(cand) or not len(ask):
            return pd.DataFrame({"query_row": [], "query_id": [], "row": [], "id": [], "no_id": [], "score": []})
        i, j, s = search(_matrix(cand), cand["row"].to_numpy(), cand["id"].to_numpy(), _matrix(ask), ask["row"].to_numpy(), k)
        return pd.DataFrame({"query_row": ask["row"].to_numpy()[i], "query_id": ask["id"].to_numpy()[i], "row": cand["row"].to_numpy()[j],
                             "id": cand["id"].to_numpy()[j], "no_id": cand["no_id"].to_numpy()[j], "score": s})

    keys = ["dim", "stripe", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        run, "query_row long, query_id long, row long, id long, no_id boolean, score long")
    first = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "no_id", "id", "row")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.when(~F.col("no_id"), F.col("id")).alias("vec_id"), "score")
