"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Method. Vectors become integers once and are written as blocks (one binary matrix a row). With X the
centred rows, every step is one pass over the blocks: p = Xv in each task, and the sums of p², Xᵀp
and Uᵀp over all rows. From these the driver gets the next pair of bidiagonal entries: u is p
without its parts along all earlier u (full reorthogonalisation), Xᵀu follows from Xᵀp, and the next
v is Xᵀu without its parts along all earlier v, taken out twice. The long vectors u are never stored: by
X V = U R they are rows of X V times the inverse of the small matrix R, so a task makes its part of
them anew. When an invariant space is exhausted the iteration goes on from a fresh direction. The
SVD of the small bidiagonal matrix gives the components and their deviations. Steps end when the
residuals of the wanted triplets are at rounding level, at the latest after one step a dimension.

Only sums leave the tasks: about twice the dimension numbers each, added up in ``SLOTS`` groups.

Defined results: a vector that is null, empty or holds a null or a non-finite entry is dropped; of
several lengths the most frequent one counts (the greater of equally frequent ones), other vectors
are dropped. Entries beyond 2**50 after scaling are set to that bound. Null ids and repeated rows
stay. Directions without variance give no component, so fewer than ``k`` may come back, and none for
an empty table or equal vectors. ``deviation`` is null where it exceeds a long. Other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, shared_table

BLOCK_BYTES = 1 << 20
SLOTS = 16
SCALE, SHIFT, BOUND = 1024, 100_000, 2.0 ** 50
RESIDUAL = 1e-14   # of the largest singular value
NO_VARIANCE = 1e-12  # of the largest deviation: below it a direction counts as constant
LONG = float(1 << 63)
BLOCKS = "ids array<long>, x binary"
RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def valid_vectors(df: DataFrame, id_col: str, emb_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(emb_col, lambda c: c.cast("double")).alias("e"))
    bad = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("e").isNotNull() & (F.size("e") > 0) & ~bad)


def blocks_of(dim: int):
    """Integer matrices of at most BLOCK_BYTES, one a row."""
    step = max(1, BLOCK_BYTES // (8 * dim))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, col = batch.column(0), batch.column(1)
            e = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = np.clip(np.floor(e * SCALE), -BOUND, BOUND).astype(np.int64) + SHIFT
            for lo in range(0, len(x), step):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.slice(lo, step).to_pylist()], pa.list_(pa.int64())), pa.array([x[lo:lo + step].tobytes()], pa.binary())],
                    ["ids", "x"])
    return run


def matrices(batch: pa.RecordBatch, dim: int):
    for raw in batch.column(batch.schema.get_field_index("x")):
        yield np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, dim)


def exact_sums(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension."""
    def run(batches):
        for batch in batches:
            n, sums = 0, [0] * dim
            for x in matrices(batch, dim):
                n += len(x)
                # two halves, so that no sum of a block leaves 64 bits
                high, low = (x >> 24).sum(axis=0).tolist(), (x & 0xFFFFFF).sum(axis=0).tolist()
                sums = [s + (h << 24) + q for s, h, q in zip(sums, high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(v) for v in (n, *sums)])], ["i", "v"])
    got = dict(blocks.select("x").mapInArrow(run, "i int, v string").groupBy("i")
               .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    return int(got.get(-1, 0)), [int(got.get(i, 0)) for i in range(dim)]


def summed(blocks: DataFrame, dim: int, width: int, part) -> np.ndarray:
    """Sum over all rows of ``part(centred or plain matrix) -> width numbers``."""
    def run(batches):
        slot = TaskContext.get().partitionId() % SLOTS
        total = np.zeros(width)
        for batch in batches:
            for x in matrices(batch, dim):
                total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["slot", "v"])
    sums = (blocks.select("x").mapInArrow(run, "slot int, v array<double>").groupBy("slot")
            .agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("v")))).alias("v")).collect())
    return np.sum([r.v for r in sums], axis=0) if sums else np.zeros(width)


@dataclass
class Basis:
    """Components as columns, eigenvalues of the covariance, its trace, what centres the rows."""
    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    steps: int
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.values)


def lanczos(blocks: DataFrame, dim: int, n: int, sums: list[int], k: int) -> Basis:
    mean = np.array([s / n for s in sums])
    rng = np.random.default_rng(7)

    def direction(v: np.ndarray, fresh: np.ndarray) -> np.ndarray | None:
        """``fresh`` without its part along the columns of v (twice), or None."""
        for _ in range(2):
            fresh = fresh - v @ (v.T @ fresh)
        size = np.linalg.norm(fresh)
        return fresh / size if size > 1e-8 else None

    v = np.zeros((dim, 0))
    v = np.column_stack([v, direction(v, rng.standard_normal(dim))])
    alpha: list[float] = []   # one a step, 0 where Xv lies in the space of earlier u
    beta: list[float] = []    # from step j to j + 1, 0 after a restart
    xtu = np.zeros((dim, 0))  # Xᵀu of the steps with alpha > 0
    tri = np.zeros((dim, dim))  # R: U of those steps = (X V) R^-1
    live: list[int] = []
    total = 0.0
    scale = 0.0
    while True:
        j = v.shape[1] - 1
        back = np.linalg.inv(tri[:len(live), :len(live)]) if live else np.zeros((0, 0))
        cols = list(live)

        def part(x, v=v, back=back, cols=cols):
            c = x - mean
            p = c @ v[:, -1]
            u = (c @ v[:, cols]) @ back if cols else np.zeros((len(c), 0))
            out = np.zeros(2 * dim + 2)
            out[:dim] = c.T @ p
            out[dim:dim + len(cols)] = u.T @ p
            out[2 * dim], out[2 * dim + 1] = p @ p, np.einsum("ij,ij->", c, c)
            return out
        got = summed(blocks, dim, 2 * dim + 2, part)
        along, total = got[dim:dim + len(cols)], got[2 * dim + 1]
        rest = got[2 * dim] - along @ along
        scale = max(scale, np.sqrt(max(got[2 * dim], 0.0)))
        if rest <= (1e-7 * scale) ** 2 or scale == 0.0:
            alpha.append(0.0)
            nxt = None
        else:
            a = float(np.sqrt(rest))
            alpha.append(a)
            tri[:len(live), len(live)], tri[len(live), len(live)] = along, a
            xtu = np.column_stack([xtu, (got[:dim] - xtu @ along) / a])
            live.append(j)
            residual = xtu[:, -1] - v @ (v.T @ xtu[:, -1])
            residual -= v @ (v.T @ residual)
            nxt = residual if np.linalg.norm(residual) > 1e-12 * scale else None
        small = np.diag(alpha) + np.diag(beta, 1) if beta else np.diag(alpha)
        left, s, right = np.linalg.svd(small)
        reach = float(np.linalg.norm(nxt)) if nxt is not None else 0.0
        done = v.shape[1] == dim
        if not done and nxt is not None and v.shape[1] > k:
            done = bool((reach * np.abs(left[-1, :k]) <= RESIDUAL * s[0]).all())
        if not done and nxt is None:  # an invariant space: finished if nothing is left outside it
            done = scale == 0.0 or (total - (s ** 2).sum()) <= 1e-13 * total
        if done:
            break
        if nxt is None:
            fresh = direction(v, rng.standard_normal(dim))
            if fresh is None:
                break
            beta.append(0.0)
        else:
            fresh = nxt / reach
            beta.append(reach)
        v = np.column_stack([v, fresh])
    keep = int((s[:k] > NO_VARIANCE ** 0.5 * s[0]).sum()) if s[0] > 0 else 0
    components = v @ right[:keep].T
    components /= np.linalg.norm(components, axis=0) if keep else 1.0
    return Basis(n, sums, mean, components, s[:keep] ** 2 / n, total / n, v.shape[1])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """Exact sums of (n x - S)²; None where one exceeds a long."""
    s = np.array([float(v) for v in sums])
    about = ((x * float(n) - s) ** 2).sum(axis=1)
    fits = about < LONG * 0.999
    wide = np.abs(x).max(initial=0) * float(n) >= LONG / 2 or np.abs(s).max(initial=0) >= LONG / 2
    out: list = [None] * len(x)
    if not wide:
        t = x[fits] * n - np.array(sums, np.int64)
        for i, value in zip(np.flatnonzero(fits).tolist(), (t * t).sum(axis=1).tolist()):
            out[i] = value
    for i in np.flatnonzero((about < LONG * 1.001) & (np.full(len(x), wide) | ~fits)).tolist():
        value = sum((n * a - b) ** 2 for a, b in zip(x[i].tolist(), sums))
        out[i] = value if value < 1 << 63 else None
    return out


def fit(blocks: DataFrame, dim: int, k: int) -> Basis | None:
    n, sums = exact_sums(blocks, dim)
    if not n:
        return None
    basis = lanczos(blocks, dim, n, sums, k)
    m = len(basis.values)
    if m:
        # the whitened rows' covariance, centred by their own mean, tells how well it worked
        def part(x):
            z = basis.whiten(x)
            return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])
        got = summed(blocks, dim, m * m + m, part) / n
        mean = got[m * m:]
        basis.identity_error = float(np.abs(got[:m * m].reshape(m, m) - np.outer(mean, mean) - np.eye(m)).max())
    return basis


def whiten(df: DataFrame, k: int = 8, id_col: str = "vec_id", emb_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every row
    and component."""
    spark = df.sparkSession
    prepare(spark)
    rows = valid_vectors(df, id_col, emb_col)
    lengths = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], RESULT)
    dim = lengths[0].d
    blocks = shared_table(rows.where(F.size("e") == dim).mapInArrow(blocks_of(dim), BLOCKS), "blocks")
    basis = fit(blocks, dim, min(k, dim))
    m = len(basis.values)
    if not m:
        return spark.createDataFrame([], RESULT)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for ids, x in zip(batch.column(at).to_pylist(), matrices(batch, dim)):
                size = len(x) * m
                dev = deviations(x, basis.n, basis.sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i in ids for _ in range(m)], pa.int64()), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(size, basis.n, np.int64)), pa.array([d for d in dev for _ in range(m)], pa.int64()),
                     pa.array(basis.whiten(x).ravel()), pa.array(np.tile(basis.values / basis.trace, len(x))),
                     pa.array(np.full(size, basis.identity_error))],
                    [c.split()[0] for c in RESULT.split(", ")])
    return blocks.mapInArrow(run, RESULT)
