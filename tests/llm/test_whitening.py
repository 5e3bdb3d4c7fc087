"""Whitening against NumPy's own solver and exact integer sums."""

import math

import numpy as np
import pytest

from entitywatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n string, x string, i long"


def table_of(spark, vectors):
    return spark.createDataFrame([(k, v, 1, 2, "n", "x", 3) for k, v in vectors], SCHEMA).repartition(5)


def orthonormal(rng, d):
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    return q + q @ (np.eye(d) - q.T @ q) / 2


@pytest.mark.parametrize("values", [np.linspace(1, 10, 30), 10.0 ** np.arange(-6, 7), 1 + np.arange(8) * 1e-10])
def test_components_to_double_precision(values):
    q = orthonormal(np.random.default_rng(1), len(values))
    a = (q * values.astype(np.longdouble)) @ q.T
    found, x = whitening.refine((a + a.T) / 2)
    order = np.argsort(-values)
    assert np.allclose(found.astype(float), values[order], rtol=1e-12)
    assert np.abs(np.abs(np.einsum("ij,ij->j", q[:, order], x)) - 1).max() < 1e-15


def test_equal_eigenvalues_keep_the_subspace():
    q = orthonormal(np.random.default_rng(2), 9)
    values = np.array([5, 2, 2, 2, 1, 0, 0, 0, 0], np.longdouble)
    a = (q * values) @ q.T
    found, x = whitening.refine((a + a.T) / 2)
    assert np.abs(found - values).max() < 1e-15 and np.abs(x.T @ x - np.eye(9)).max() < 1e-17
    assert np.abs(x[:, 1:4] @ x[:, 1:4].T - q[:, 1:4] @ q[:, 1:4].T).max() < 1e-15


def test_whitened_rows(spark):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(400, 6)) @ rng.normal(size=(6, 20)) + rng.normal(size=(400, 20)) * 0.1 + 3).astype(np.float32)
    vectors = [(k, v.tolist()) for k, v in enumerate(base)] + [(1000 + k, base[0].tolist()) for k in range(300)] + [(None, base[5].tolist())]
    odd = [(2000, None), (2001, [1.0] * 19 + [None]), (2002, [math.nan] * 20), (2003, [math.inf] + [0.0] * 19), (2004, []), (2005, [1.0, 2.0])]
    rows = whitening.whitened_components(table_of(spark, vectors + odd), components=16).collect()
    x = np.floor(64 * base.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(v) for v in fit.sum(0)]
    e, c = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    e, c = e[::-1], c[:, ::-1]
    expected = (x - np.array(sums) / n) @ c[:, :16] / np.sqrt(e[:16])
    assert len(rows) == 16 * len(vectors) and sum(r.vec_id is None for r in rows) == 16
    signs = {r.component: np.sign(r.whitened * expected[0, r.component - 1]) for r in rows if r.vec_id == 0}
    for r in rows:
        k = 5 if r.vec_id is None else 0 if r.vec_id >= 1000 else r.vec_id
        assert abs(r.whitened * signs[r.component] - expected[k, r.component - 1]) < 1e-8
        assert r.n == n and r.deviation == sum((n * int(v) - s) ** 2 for v, s in zip(x[k], sums))
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-8


def test_directions_without_variance_are_left_out(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(50, 2)).astype(np.float32)
    rows = whitening.whitened_components(table_of(spark, [(k, [a, b, a, 1.0, b]) for k, (a, b) in enumerate(v.tolist())])).collect()
    assert {r.component for r in rows} == {1, 2} and all(r.identity_error < 1e-9 for r in rows)
    assert whitening.whitened_components(table_of(spark, [(1, [1.0, 2.0])] * 9)).count() == 0
    assert whitening.whitened_components(table_of(spark, [(1, None), (2, [math.nan])])).count() == 0
    assert whitening.whitened_components(spark.createDataFrame([], SCHEMA)).columns[:4] == ["vec_id", "component", "n", "deviation"]


def test_huge_entries_stay_exact_or_become_null(spark):
    rows = whitening.whitened_components(table_of(spark, [(1, [3e38, 0.0]), (2, [1e9, 1.0]), (3, [2e9, 2.0])])).collect()
    assert rows and all(r.deviation is None for r in rows)
    rows = whitening.whitened_components(table_of(spark, [(1, [4e6, 0.0]), (2, [1e6, 1.0]), (3, [2e6, 2.0])])).collect()
    x = [[int(64 * a) + 1_000_000, int(64 * b) + 1_000_000] for a, b in ((4e6, 0), (1e6, 1), (2e6, 2))]
    sums = [sum(c) for c in zip(*x)]
    assert {r.vec_id: r.deviation for r in rows} == {k + 1: sum((3 * v - s) ** 2 for v, s in zip(row, sums)) for k, row in enumerate(x)}
