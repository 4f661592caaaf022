"""Exact top-k by inner product: aggregation of sorted lists without random access.

Method. Candidates are dealt to blocks by a hash of their id and queries to blocks of their own; a
task takes one pair of blocks, as in a blocked matrix product. In a block every dimension is a list
sorted by component, read from the end that a query's sign favours. All lists are read to the same
depth, and depth grows step by step. What has been read gives every candidate a lower bound
(unread components at their worst) and an upper bound (unread components at the last value read);
both are matrix products over all queries that are still open. A query stops when few enough
candidates can still reach its k-th lower bound; outsiders below it can't qualify any more, and the
rest get their final scores. Equal vectors share one place, with their k + 1 smallest ids.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part;
vectors of different widths are never compared; ties go to the smaller id; null ids take no part;
a repeated (id, vector) row counts once; an empty table gives an empty result. Components are
floor(scale * x); products are 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, shared_table

BLOCK = 1024
QUERY_BLOCK = 1024
STEPS = (0.125, 0.5, 1.0)
FEW = 48
SCHEMA = "query_id long, vec_id long, score long"


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """(query id, candidate id, score) of each query's k best in this block, its own row excluded."""
    order = np.lexsort((ids, *x.T[::-1]))
    x, ids = x[order], ids[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]).any(1)
    place = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    nth = np.arange(len(x)) - first[place]
    keep = nth <= k  # k + 1 ids of a vector: one of them may be the query's own
    x_all, place, ids = x, place[keep], ids[keep]
    x = x_all[first]
    n, d = x.shape
    xs = np.sort(x, axis=0)
    rank = np.empty((n, d), np.int64)
    np.put_along_axis(rank, np.argsort(x, axis=0, kind="stable"), np.arange(n)[:, None], axis=0)
    out_q, out_c, out_s = [], [], []
    open_q = np.arange(len(q))
    # copies of a vector all count for k; a query's own place may lose one
    copies = np.bincount(place, minlength=n)
    for step in STEPS:
        t = max(1, math.ceil(n * step))
        from_top, from_end = rank >= n - t, rank < t
        up = np.concatenate([np.where(from_top, x, xs[n - t]), np.where(from_end, x, xs[t - 1])], 1).astype(np.float64)
        low = np.concatenate([np.where(from_top, x, xs[0]), np.where(from_end, x, xs[-1])], 1).astype(np.float64)
        qq = np.concatenate([np.maximum(q[open_q], 0), np.minimum(q[open_q], 0)], 1).astype(np.float64)
        upper, lower = qq @ up.T, qq @ low.T
        slack = 1e-9 * (np.abs(qq).sum(1) * max(1.0, float(np.abs(xs).max())))
        m = min(k + 1, n)  # one more: the query's own row doesn't count
        kth = np.partition(lower, n - m, axis=1)[:, n - m] if n > m else np.full(len(open_q), -np.inf)
        alive = upper >= (kth - slack)[:, None]
        stop = (alive.sum(1) <= FEW) if t < n else np.ones(len(open_q), bool)
        a, b = np.nonzero(alive & stop[:, None])
        if len(a):
            score = np.einsum("ij,ij->i", q[open_q[a]], x[b])
            reps = copies[b]
            start = np.searchsorted(place, b)
            a, score = np.repeat(a, reps), np.repeat(score, reps)
            at = np.repeat(start - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(len(a))
            c = ids[at]
            other = c != q_ids[open_q[a]]
            a, c, score = a[other], c[other], score[other]
            o = np.lexsort((c, -score, a))
            a, c, score = a[o], c[o], score[o]
            head = np.ones(len(a), bool)
            head[1:] = a[1:] != a[:-1]
            pos = np.arange(len(a)) - np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
            top = pos < k
            out_q.append(q_ids[open_q[a[top]]])
            out_c.append(c[top])
            out_s.append(score[top])
        open_q = open_q[~stop]
        if not len(open_q):
            break
    cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return cat(out_q), cat(out_c), cat(out_s)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    values = table.column("v").combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(values), -1), table.column("vec_id").to_numpy().astype(np.int64)


def pair_of_blocks(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            got = (np.zeros(0, np.int64),) * 3
        else:
            x, ids = _matrix(left)
            q, q_ids = _matrix(right)
            got = search_block(q, q_ids, x, ids, k)
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.int64())})

    return run


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, integer vector, width; only rows that take part, each once."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & (F.size(x) > 0) & ~F.exists(
        x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    return (vectors.where(F.coalesce(fine, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("v"))
            .withColumn("width", F.size("v")).dropDuplicates(["vec_id", "v"]))


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row for which ``is_query`` holds,
    among all other rows."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = shared_table(quantised(vectors, scale), "topk_vectors")
    queries = rows.where(is_query)
    n, m = rows.count(), queries.count()
    blocks, q_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(m / query_block))
    left = (rows.withColumn("b", F.expr(f"pmod(xxhash64(vec_id), {blocks})"))
            .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    right = (queries.withColumn("c", F.expr(f"pmod(xxhash64(vec_id), {q_blocks})").cast("int"))
             .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    key = ["width", "b", "c"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(pair_of_blocks(k), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
