"""Whitening against a plain eigen decomposition."""

import math

import numpy as np
import pytest

from conftest import SF_SMALL
from labelflow.llm import whitening


def brute(rows, k):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return None
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    c = x.astype(float) - np.array([b / n for b in s])
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    k = min(k, int((e > 1e-10 * e[0]).sum())) if e[0] > 0 else 0
    return [i for i, _ in kept], n, dev, c @ w[:, :k] / np.sqrt(e[:k]) if k else None, e[:k] / max(e.sum(), 1e-300)


def check(spark, rows, k=8, tol=1e-7):
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, n long, x string").repartition(3)
    got = whitening.whiten(df, k).collect()
    want = brute(rows, k)
    if want is None or want[3] is None:
        assert got == []
        return
    ids, n, dev, z, share = want
    assert len(got) == len(ids) * z.shape[1] and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-8 and len({r.identity_error for r in got}) == 1
    by = {}
    for r in got:
        by.setdefault((-1 if r.vec_id is None else r.vec_id, r.component), []).append(r)
    for j in range(z.shape[1]):
        plain = np.array([by[-1 if i is None else i, j + 1][0].whitened for i in ids])
        same, other = np.abs(plain - z[:, j]).max(), np.abs(plain + z[:, j]).max()
        assert min(same, other) < tol
        assert abs(by[-1 if ids[0] is None else ids[0], j + 1][0].explained - share[j]) < 1e-9
    for i, d in zip(ids, dev):
        assert all(r.deviation == (d if d < 1 << 63 else None) for r in by[-1 if i is None else i, 1])


def test_equals_eigen_decomposition(spark):
    rng = np.random.default_rng(1)
    scale = np.linspace(3, 0.2, 20)
    rows = [(i, (rng.standard_normal(20) * scale).tolist()) for i in range(300)]
    check(spark, rows)
    check(spark, rows, k=3)


def test_nulls_non_finite_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(5) * [5, 4, 3, 2, 1]).tolist()) for i in range(40)]
    rows += [(50, None), (51, [1.0, None, 2.0, 3.0, 4.0]), (52, [float("nan")] * 5), (53, [float("inf")] + [0.0] * 4), (54, []),
             (None, [0.5] * 5), (7, rows[7][1])]
    check(spark, rows)


def test_few_rows_rank_and_constant_vectors(spark):
    check(spark, [(1, [1.0, 2.0])])
    check(spark, [(i, [3.0, 4.0]) for i in range(5)])
    check(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])           # rank 1
    check(spark, [(i, [float(i % 3), float(i % 2), 0.0, 0.0]) for i in range(12)])  # an invariant space ends early
    check(spark, [])


def test_other_lengths_are_dropped(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0]), (4, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in whitening.whiten(df).collect()} == {1, 2, 4}


def test_large_entries_and_deviations_beyond_a_long(spark):
    check(spark, [(i, [1e4 * i, float(i * i)]) for i in range(6)], tol=1e-5)
    check(spark, [(i, [1e9 * i, float(i * i)]) for i in range(6)], k=1, tol=1e-5)
    df = spark.createDataFrame([(i, [1e300 * (-1) ** i, 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(df).collect()} == {None}


def test_a_close_spectrum_converges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(2000)]
    check(spark, rows, tol=1e-6)


def test_the_given_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    got = whitening.whiten(df).collect()
    n = df.count()
    assert len(got) == 8 * n and {r.component for r in got} == set(range(1, 9)) and got[0].identity_error < 1e-8
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids, _, dev, z, _ = brute(rows, 8)
    mine = {(r.vec_id, r.component): r.whitened for r in got}
    for j in range(8):
        plain = np.array([mine[i, j + 1] for i in ids])
        assert min(np.abs(plain - z[:, j]).max(), np.abs(plain + z[:, j]).max()) < 1e-6


@pytest.mark.parametrize("n, sums", [(3, [30, 60]), (10 ** 12, [10 ** 17, 10 ** 17])])
def test_exact_deviations(n, sums):
    x = np.array([[10, 20], [100_001, 99_999], [2 ** 40, 5]])
    want = [sum((n * a - b) ** 2 for a, b in zip(r, sums)) for r in x.tolist()]
    assert whitening.deviations(x, n, sums) == [v if v < 1 << 63 else None for v in want]
