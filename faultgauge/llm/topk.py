"""Exact top-k by inner product: columnar branch and bound.

Queries and candidates are dealt into blocks by the hash of their ids; each pair of blocks is a task of bounded
size. In it, candidates lie by dimension. For one query, partial products are summed over one block of
dimensions after the other. A candidate can gain at most the product of both vectors' norms over the
dimensions still to come; those that cannot reach the k-th score any more are dropped from the columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

DIMENSIONS = 16  # in one step
CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 1_024
FOUND = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
EXACT = 2**53  # integers below are exact as doubles


def quantised(vector: Column, scale: float = 64.0) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Neither null nor empty, nor holding a null, a NaN or an infinity."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def search(q_ids, q_keys, queries, c_ids, c_keys, candidates, k: int) -> list[np.ndarray]:
    """Columns query_id, query_key, vec_id, score: the k best candidates of each query, ties to smaller ids."""
    order = np.lexsort((c_keys, c_ids))
    c_ids, c_keys, candidates = c_ids[order], c_keys[order], candidates[order]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    kind = np.float64 if bound < EXACT else np.int64  # the latter wraps beyond 64 bits, as a long does
    width = queries.shape[1]
    cuts = list(range(0, width, DIMENSIONS))
    columns = [np.ascontiguousarray(candidates[:, a : a + DIMENSIONS].T.astype(kind)) for a in cuts]

    def masses(x: np.ndarray) -> list[np.ndarray]:
        """Norms over the dimensions after each block."""
        squares = np.square(x.astype(np.float64))
        return [np.sqrt(squares[:, a + DIMENSIONS :].sum(axis=1)) for a in cuts]

    mass_c, mass_q = masses(candidates), masses(queries)
    n = len(c_ids)
    seed = np.unique(np.linspace(0, n - 1, min(n, 16 * k)).astype(np.int64)) if n else np.empty(0, np.int64)
    seed_rows = candidates[seed].astype(kind)
    out = []
    for i in range(len(q_ids)):
        q = queries[i].astype(kind)
        own = (c_ids == q_ids[i]) & (c_keys == q_keys[i])
        # the k-th score of a few candidates, without the query itself, is a floor for the k-th score of all
        floor = -math.inf
        scores = seed_rows @ q
        scores = scores[~own[seed]]
        if len(scores) >= k:
            floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        alive = np.flatnonzero(~own)
        partial = np.zeros(len(alive), kind)
        for step, a in enumerate(cuts):
            block = columns[step] if len(alive) == n else columns[step][:, alive]
            partial = partial + q[a : a + DIMENSIONS] @ block
            if a + DIMENSIONS < width and floor > -math.inf:
                # a little more than the bound, as norms are rounded
                most = partial + mass_q[step][i] * mass_c[step][alive] * (1 + 1e-9) + 1e-6
                keep = most >= floor
                if not keep.all():
                    alive, partial = alive[keep], partial[keep]
        if len(alive) > k:
            kth = np.partition(partial, len(partial) - k)[len(partial) - k]
            keep = partial >= kth
            alive, partial = alive[keep], partial[keep]
        best = np.argsort(-partial, kind="stable")[:k]  # alive is in the order of ids
        out.append((i, alive[best], partial[best].astype(np.int64)))
    if not out:
        return [np.empty(0, np.int64)] * 4
    who = np.repeat([i for i, _, _ in out], [len(a) for _, a, _ in out]).astype(np.int64)
    found = np.concatenate([a for _, a, _ in out])
    return [q_ids[who], q_keys[who], c_ids[found], np.concatenate([s for _, _, s in out])]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``vectors(vec_id, embedding)`` that ``is_query`` holds for.

    Components become ``floor(scale * x)``; the score is their integer inner product. Candidates are all rows
    but the query's own; ties go to the smaller ``vec_id``. Rows without an id, with a null or empty vector, or
    with null or non-finite components take no part; vectors meet only those of their own length. A row that
    repeats another one is the same row; rows that share an id but not the vector are different ones. No
    usable row, no result.
    """
    rows = (
        vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
        .filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .select("vec_id", "asks", quantised(F.col("embedding"), scale).alias("v"))
        .withColumns({"key": F.xxhash64("v"), "width": F.size("v")})
        .dropDuplicates(["vec_id", "key", "v"])
    )
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    candidate_blocks = max(1, math.ceil(sizes["n"] / CANDIDATE_BLOCK))
    query_blocks = max(1, math.ceil(sizes["q"] / QUERY_BLOCK))

    def block(salt: int, count: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "key", F.lit(salt)), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    asked = rows.filter("asks").select("vec_id", "key", "v", "width", block(1, query_blocks).alias("qb"), every(candidate_blocks).alias("cb"))
    there = rows.select("vec_id", "key", "v", "width", block(2, candidate_blocks).alias("cb"), every(query_blocks).alias("qb"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        sides = []
        for side in (left, right):
            sides += [side["vec_id"].to_numpy(), side["key"].to_numpy(), matrix(side["v"])]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in search(*sides, k)], schema=FOUND)

    on = ["width", "qb", "cb"]
    found = asked.groupBy(*on).cogroup(there.groupBy(*on)).applyInArrow(cell, "query_id long, query_key long, vec_id long, score long")
    best = W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
