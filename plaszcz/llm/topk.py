"""Exact top-k inner products by the three-phase uniform threshold algorithm (Cao and Wang, 2004).

A score is the sum of partial scores over groups of dimensions, the lists. Phase 1: a few
cells of candidates, for each query its own, gather the best of each list and resolve these in
full; the k-th best of them is a score that the true k-th best cannot fall below. Phase 2: that
cutoff goes to every cell. A cell leaves out candidates whose length times the query's stays
below the cutoff, and keeps those of which some list reaches cutoff / m, as a total of m lists
that all stay below it stays below the cutoff. Phase 3: the scores of those kept are resolved
exactly and the best k of them returned.

Queries and candidates are dealt to a grid of cells by block numbers, so the work is spread
over (query blocks x candidate cells) tasks, and no side is broadcast. Exact search by inner
product has no bound that always saves work: where vectors are equally long and evenly spread,
phase 2 multiplies every query with every candidate, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bound_batches, stage, table

SCALE = 64
LISTS = 4
#: Cells that give a query its cutoff.
FIRST_CELLS = 2


def quantise(df: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec binary of little-endian 64-bit floats): floor(scale * x) of each component.

    Vectors that are null, empty or hold a null or non-finite component are left out, and so are
    rows without an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    ids.append(i)
                    vecs.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "vec": pa.array(vecs, pa.binary())})

    return df.select(F.col(vec_id).cast("long"), embedding).mapInArrow(run, "vec_id bigint, vec binary")


def _matrix(vecs: pa.Array) -> np.ndarray:
    data = np.frombuffer(b"".join(vecs.to_pylist()), "<f8")
    return data.reshape(len(vecs), -1) if len(vecs) else data.reshape(0, 0)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; by floats where these are exact, which they are below 2**53."""
    bound = (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(initial=0) + 1) * a.shape[1]
    return (a @ b.T).astype(np.int64) if bound < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def _lists(n_dims: int, m: int) -> list[slice]:
    edges = [n_dims * i // m for i in range(m + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row (all if fewer), ties to the left, in no order."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    key = scores * n + np.arange(n - 1, -1, -1)
    return np.argpartition(key, n - k, axis=1)[:, n - k :]


def _hide_self(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray) -> None:
    at = np.minimum(np.searchsorted(ids, query_ids), len(ids) - 1)
    rows = np.flatnonzero(ids[at] == query_ids)
    for r in rows:  # equal ids stand side by side
        a, b = np.searchsorted(ids, query_ids[r]), np.searchsorted(ids, query_ids[r], side="right")
        scores[r, a:b] = _LOWEST


_LOWEST = -(2**40)


def first_phase(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of queries, exact score) of up to k candidates of one block for each query; ids ascend."""
    every = np.zeros((len(queries), len(ids)), bool)
    for part in _lists(vectors.shape[1], m):
        local = _exact(queries[:, part], vectors[:, part])
        _hide_self(local, query_ids, ids)
        np.put_along_axis(every, _best(local, k), True, axis=1)
    row, col = np.nonzero(every)
    score = np.einsum("ij,ij->i", queries[row].astype(np.int64), vectors[col].astype(np.int64))
    keep = query_ids[row] != ids[col]
    return row[keep], score[keep]


def later_phases(query_ids: np.ndarray, queries: np.ndarray, cutoff: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of queries, vec_id, exact score) of the block's best k that reach the cutoff (null: -inf)."""
    lists = _lists(vectors.shape[1], m)
    reached = np.zeros((len(queries), len(ids)), bool)
    for part in lists:
        reached |= _exact(queries[:, part], vectors[:, part]) * len(lists) >= cutoff[:, None]
    _drop_self(reached, query_ids, ids)
    row, col = np.nonzero(reached)
    score = np.empty(len(row), np.int64)
    q, v = queries.astype(np.int64), vectors.astype(np.int64)
    for a in range(0, len(row), 200_000):
        b = a + 200_000
        score[a:b] = np.einsum("ij,ij->i", q[row[a:b]], v[col[a:b]])
    keep = score >= cutoff[row]
    row, col, score = row[keep], col[keep], score[keep]
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], ids[col[rank < k]], score[rank < k]


def _drop_self(mask: np.ndarray, query_ids: np.ndarray, ids: np.ndarray) -> None:
    a, b = np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, side="right")
    for r in np.flatnonzero(b > a):
        mask[r, a[r] : b[r]] = False


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, lists: int = LISTS, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates of another id, ties to the smaller vec_id.

    Both sides are (vec_id, vec) as quantise gives them; vectors of different lengths raise an error. Rows
    that repeat a query's id are no candidates of it; a query id that repeats is one query (the
    first of its vectors in byte order). Candidates that repeat in id and vector count each.
    Without candidates, or without queries, no rows.
    """
    spark = candidates.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    bound_batches(spark)
    sizes = [df.agg(F.count("*"), F.min(F.octet_length("vec")), F.max(F.octet_length("vec"))).first() for df in (queries, candidates)]
    if len({x for s in sizes for x in s[1:] if x is not None}) > 1:
        raise ValueError("vectors differ in length")
    n_query = max(1, -(-sizes[0][0] // (4 * block_rows)))
    n_cell = max(1, -(-sizes[1][0] // block_rows))
    n_cell = max(n_cell, min(64, -(-spark.sparkContext.defaultParallelism // n_query)))
    row = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30))
    # grid: candidates have a cell and go to every query block, queries have a block and go to every cell
    cand = candidates.select(F.pmod(row, F.lit(n_cell)).alias("_cell"), F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("_block"), "vec_id", "vec")
    asked = queries.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_query)).cast("int"))

    def to_cells(df: DataFrame, most: int) -> DataFrame:
        """Each query in its block's cells, up to `most` of them from one that its id chooses."""
        step = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(most, n_cell) - 1).cast("long")))
        return df.withColumn("_cell", step).withColumn("_cell", F.pmod(F.col("_cell") + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_cell)), F.lit(n_cell)))

    def sides(left: pa.Table, right: pa.Table) -> tuple:
        q = left.combine_chunks().sort_by("vec_id")
        c = right.combine_chunks().sort_by("vec_id")
        return q, q.column("vec_id").to_numpy(), _matrix(q.column("vec")), c.column("vec_id").to_numpy(), _matrix(c.column("vec"))

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        _, q_ids, q, ids, v = sides(left, right)
        out = []
        for a in range(0, len(q), 256):
            row, score = first_phase(q_ids[a : a + 256], q[a : a + 256], ids, v, k, lists)
            order = np.lexsort((-score, row))
            row, score = row[order], score[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((q_ids[a + row[top]], score[top]))
        i, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": i, "score": s})

    def later(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        table_, q_ids, q, ids, v = sides(left, right)
        cutoff = table_.column("cutoff").to_numpy()
        length, q_length = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
        out = []
        for a in range(0, len(q), 256):
            few = slice(a, a + 256)
            # a product is at most the product of the lengths; the slight rest covers rounding
            needed = np.min(np.where(cutoff[few] > 0, cutoff[few] / np.maximum(q_length[few], 1e-9), 0.0)) * (1 - 1e-9)
            can = length >= needed
            row, vec, score = later_phases(q_ids[few], q[few], cutoff[few], ids[can], v[can], k, lists) if can.any() else (np.empty(0, np.int64),) * 3
            out.append((q_ids[a + row], vec, score))
        i, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": i, "vec_id": c, "score": s})

    key = ["_cell", "_block"]
    phase1 = to_cells(asked, FIRST_CELLS).groupBy(*key).cogroup(cand.groupBy(*key)).applyInArrow(first, "query_id bigint, score bigint")
    ranked = phase1.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    cutoffs = ranked.filter(F.col("_n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    bounded, _ = stage(asked.join(cutoffs, "vec_id", "left").fillna(-(2**53), ["cutoff"]), "cutoffs")
    found = to_cells(bounded, n_cell).groupBy(*key).cogroup(cand.groupBy(*key)).applyInArrow(later, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every 20th vector, by integer inner product."""
    vectors, _ = stage(quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return top_k(vectors.filter("vec_id % 20 = 0"), vectors)
