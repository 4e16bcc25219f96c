"""Whitening against a dense eigendecomposition of small tables."""

import numpy as np
import pytest

from offerloom.llm import whitening

VECTORS = "vec_id bigint, embedding array<double>, label int, x string, n int, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 5, "c") for i, v in rows], VECTORS)


def plain(vectors, most=16):
    """Per vector the exact deviation and the whitened values, and the explained shares, with signs left open."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    deviation = [sum(int(c) ** 2 for c in row) for row in x * n - sums]
    return n, deviation, ((x * n - sums) / n).astype(float) @ (axes / np.sqrt(e)), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("dim, seed", [(3, 0), (16, 1), (24, 2)])
def test_against_eigenvectors(spark, dim, seed):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(300, dim)) * np.geomspace(30, 0.5, dim) + 5
    vectors[250:] = vectors[:50]
    got = whitening.whiten(table(spark, list(enumerate(vectors)))).collect()
    n, deviation, values, explained = plain(vectors)
    assert len(got) == 300 * min(16, dim)
    signs = {}
    for r in got:
        want = values[r.vec_id, r.component - 1]
        signs.setdefault(r.component, np.sign(r.whitened * want))
        assert r.n == n == 250 and r.deviation == deviation[r.vec_id]
        assert abs(r.whitened - signs[r.component] * want) < 1e-9
        assert abs(r.explained - explained[r.component - 1]) < 1e-12 and r.identity_error < 1e-10


def test_badly_conditioned(spark):
    """Directions 10^-7 of the strongest are still whitened; one without variance has no component."""
    rng = np.random.default_rng(3)
    base = rng.integers(-50, 50, size=(400, 3)) / 64
    vectors = np.column_stack((base[:, 0] * 1e7, base[:, 1], base[:, 2], base[:, 1] + base[:, 2], np.full(400, 2.0)))
    got = whitening.whiten(table(spark, list(enumerate(vectors)))).collect()
    assert {r.component for r in got} == {1, 2, 3}
    assert max(r.identity_error for r in got) < 1e-4
    w = np.zeros((400, 3))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    exact = np.unique(np.round(w, 9), axis=0)
    assert np.abs(exact.T @ exact / len(exact) - np.eye(3)).max() < 1e-6


def test_edges(spark):
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [])]
    assert whitening.whiten(table(spark, rows)).count() == 0
    assert whitening.whiten(table(spark, rows).where("false")).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    two = [*rows, (6, [0.0, 1.0]), (6, [0.0, 1.0]), (None, [1.0, 3.0]), (8, [1.0]), (9, [2.0]), (10, [4.0]), (11, [0.001, 1.001])]
    got = whitening.whiten(table(spark, two)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (6, 1), (6, 1), (8, 1), (9, 1), (10, 1), (11, 1)]
    assert {r.n for r in got if r.vec_id in (8, 9, 10)} == {3} and {r.n for r in got if r.vec_id in (None, 6, 11)} == {2}  # 11 is 6 in whole numbers


def test_large_numbers(spark):
    """Sums and squares beyond 64 bits stay exact, or are null as a result."""
    rows = [(k, [float(1 << 40) * k, float(k % 3)]) for k in range(9)]
    got = {r.vec_id: r for r in whitening.whiten(table(spark, rows)).collect() if r.component == 1}
    _, deviation, _, _ = plain([v for _, v in rows])
    assert all(got[k].deviation == (deviation[k] if deviation[k] < 1 << 63 else None) for k in got)
    far = whitening.whiten(table(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 1.0])]))
    assert far.count() >= 3


def test_triangular_solves():
    rng = np.random.default_rng(0)
    r = [np.triu(rng.normal(size=(6, 6))) + 4 * np.eye(6) for _ in range(2)]
    x = rng.normal(size=(10, 6))
    assert np.allclose(whitening.turned(x, r) @ r[1] @ r[0], x)
