import math
from fractions import Fraction

import numpy as np
import pytest

from taxaloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, component int"


def brute(rows):
    """Exact sums and a reference decomposition of exactly centred values."""
    ok = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(Fraction(c) * 1024) + 100000 for c in v] for _, v in ok]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    centred = np.array([[float(Fraction(a, n)) for a in r] for r in y])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return ok, n, [sum(a * a for a in r) for r in y], centred, values[order], axes[:, order]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("spread", [1.0, 1e-3])
def test_against_a_reference(spark, spread):
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.normal(size=(12, 12)))[0] * (spread * 3.0 ** -np.arange(12)) * 400
    rows = [(i, (axes @ rng.normal(size=12) / 40 + 7).tolist()) for i in range(400)]
    bad = float("nan")
    rows += [(500, None), (501, [bad] + [0.0] * 11), (502, [None] + [0.0] * 11), (503, [float("inf")] * 12), (None, rows[3][1]), (4, rows[4][1]), (4, rows[5][1]), (504, [])]
    ok, n, deviation, centred, values, vectors = brute(rows)
    got = whitening.whiten(table(spark, rows)).collect()
    k = min(8, int((values > values.sum() * 12 * 2.3e-16).sum()))
    assert len(got) == len(ok) * k
    assert sorted((r.vec_id or -1, r.component, r.n, r.deviation) for r in got) == sorted((i or -1, c, n, d) for (i, _), d in zip(ok, deviation, strict=True) for c in range(1, k + 1))
    by_id = {(r.vec_id, r.component): r.whitened for r in got}
    unique = [j for j, (i, _) in enumerate(ok) if i not in (None, 4)]
    for c in range(k):
        want = centred @ vectors[:, c] / math.sqrt(values[c])
        have = np.array([by_id[ok[j][0], c + 1] for j in unique])
        sign = np.sign(have @ want[unique])
        assert np.allclose(have, sign * want[unique], atol=1e-7)
    assert np.allclose([r.explained for r in got if r.vec_id == 7], [v / values.sum() for v in values[:k]], rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1
    w = np.array([[r.whitened for r in got if r.component == c + 1] for c in range(k)])
    measured = np.abs(np.cov(w, bias=True) - np.eye(k)).max()
    assert abs(got[0].identity_error - measured) < 1e-9 and measured < 1e-4


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    scale = 10.0 ** -np.arange(0, 18, 2)
    inner = np.eye(9) + 0.3 * np.ones((9, 9))
    values, vectors = whitening.jacobi(scale[:, None] * inner * scale)
    from decimal import Decimal, getcontext

    getcontext().prec = 60  # the determinant is a check of the smallest eigenvalue
    det = np.linalg.det(inner)
    assert math.isclose(float(np.prod([Decimal(float(v)) for v in values])), float(Decimal(float(det)) * np.prod([Decimal(float(s)) ** 2 for s in scale])), rel_tol=1e-10)
    m = rng.normal(size=(31, 31))
    m = m + m.T
    values, vectors = whitening.jacobi(m)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(31), atol=1e-13) and np.allclose(m @ vectors, vectors * values, atol=1e-12)


def test_large_numbers_are_exact(spark):
    rows = [(1, [2.0**45, 0.0]), (2, [-(2.0**45), 1.0]), (3, [2.0**20, 3.5]), (4, [1e300, 1.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, rows)).collect()}
    ok, n, deviation, *_ = brute(rows[:3])
    want = {i: d if d < 2**63 else None for (i, _), d in zip(ok, deviation, strict=True)}
    assert got == want and n == 3


def test_other_lengths_equal_vectors_and_empty_tables(spark):
    rows = [(i, [float(i % 3), float(i % 5)]) for i in range(20)] + [(30, [1.0]), (31, [1.0, 2.0, 3.0])]
    assert {r.vec_id for r in whitening.whiten(table(spark, rows)).collect()} == set(range(20))
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 4.0])])).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9))) for r in one) == [(1, 1, 1.0), (2, 1, 1.0)]
