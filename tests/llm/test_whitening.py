import math
from fractions import Fraction

import numpy as np
import pytest

from pulsewright.llm import whitening

SCHEMA = "embedding array<float>, VALUE string, vec_id long, component int, vector int"


def frame(spark, rows):
    return spark.createDataFrame([(e, "x", i, 7, 1) for i, e in rows], SCHEMA).repartition(3)


def brute(vectors):
    """Integers as stated, covariance from fractions, numpy's own solver."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    v = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    deviation = [sum((n * r[k] - s[k]) ** 2 for k in range(d)) for r in x]
    centred = np.array([[float(Fraction(n * r[k] - s[k], n)) for k in range(d)] for r in x])
    return n, v, deviation, centred


def held_against(got, rows, most=32):
    n, v, deviation, centred = brute([e for _, e in rows])
    values, vectors = (a[..., ::-1] for a in np.linalg.eigh(v))
    count = min(most, int((values > 1e-12 * np.trace(v)).sum()))
    assert len(got) == n * count
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for component in range(1, count + 1):
        want = centred @ vectors[:, component - 1] / math.sqrt(values[component - 1])
        have = np.array([by[i, component][0].whitened for i, _ in rows])
        gap = min([abs(values[component - 1] - x) for k, x in enumerate(values) if k != component - 1], default=1.0)
        if gap > 1e-6 * values[0]:
            assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        assert all(abs(r.explained - values[component - 1] / np.trace(v)) < 1e-12 and r.n == n and r.identity_error < 1e-9 for i, _ in rows for r in by[i, component])
    assert all(r.deviation == deviation[k] for k, (i, _) in enumerate(rows) for r in by[i, 1])


def test_rows_match_brute_force(spark):
    rng = np.random.default_rng(3)
    mixed = rng.standard_normal((12, 40))
    rows = [(k, (rng.standard_normal(12) @ mixed + rng.standard_normal(40) / 5).tolist()) for k in range(150)]
    vectors = frame(spark, rows)
    held_against(whitening.whiten(vectors, whitening.fit(vectors)).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    whole = [(k, rng.standard_normal(3).tolist()) for k in range(6)]
    nan, inf = float("nan"), float("inf")
    odd = [(20, None), (21, [1.0, None, 2.0]), (22, [1.0, nan, 2.0]), (23, [1.0, inf, 2.0]), (24, []), (25, [1.0, 2.0])]
    vectors = frame(spark, whole + odd)
    held_against(whitening.whiten(vectors, whitening.fit(vectors)).collect(), whole)
    twice = frame(spark, [*whole, whole[0], (None, [3.0, 1.0, 2.0])])  # repeated rows count, null ids stay
    got = whitening.whiten(twice, whitening.fit(twice)).collect()
    assert len(got) == 8 * 3 and sum(r.vec_id == 0 for r in got) == 6 and sum(r.vec_id is None for r in got) == 3 and got[0].n == 8
    for rows in ([], odd[:4], [(1, [1.0, 2.0])] * 5):  # nothing left, or nothing that differs
        none = frame(spark, rows)
        assert whitening.whiten(none, whitening.fit(none)).collect() == []
    assert whitening.whiten(none, whitening.fit(none)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_flat_directions_and_ties_are_left_out_or_kept(spark):
    rows = [(k, [float(k % 2), float(k // 2 % 2), 5.0]) for k in range(4)]  # two equal eigenvalues and a zero
    vectors = frame(spark, rows)
    held_against(whitening.whiten(vectors, whitening.fit(vectors)).collect(), rows)


def test_large_entries_stay_exact():
    y = np.array([[1 << 30, 3], [5, -(1 << 29)]])
    assert whitening.exact_products(y).tolist() == [[(1 << 60) + 25, 3 * (1 << 30) - 5 * (1 << 29)], [3 * (1 << 30) - 5 * (1 << 29), 9 + (1 << 58)]]
    fitted = whitening.Whitening(1 << 20, 2, (1 << 50, 7), np.zeros(0), np.zeros((2, 0)), 1.0)
    away, squares = whitening._centred(y, fitted)
    assert squares.tolist() == [(3 * (1 << 20) - 7) ** 2, ((5 << 20) - (1 << 50)) ** 2 + (-(1 << 49) - 7) ** 2]


@pytest.mark.parametrize("seed", range(6))
def test_inertia_counts(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((20, 20))
    a += a.T
    if seed % 2:
        a[np.diag_indices(20)] = 0
    values = np.linalg.eigvalsh(a)
    assert whitening.inertia(a) == ((values < 0).sum(), (values > 0).sum())
    assert whitening.inertia(np.zeros((3, 3))) == (0, 0)


@pytest.mark.parametrize(
    "v",
    [np.eye(40), np.diag([1.0] * 30 + [2.0] * 20), np.diag(10.0 ** -np.arange(40)), np.diag(np.r_[5.0, np.full(45, 1 + 1e-9)]), np.array([[3.0]])],
)
def test_no_component_is_missed(v):
    values, vectors = whitening.leading(v)
    want = np.linalg.eigvalsh(v)[::-1][: len(values)]
    assert len(values) == min(32, int((np.diag(v) > whitening.ZERO * np.trace(v)).sum()))
    assert np.abs(values - want).max() < 1e-13 * want[0] and np.abs(v @ vectors - vectors * values).max() < 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_contour_leaves_out_what_is_outside():
    v = np.diag(np.arange(1.0, 21.0))
    values, _ = whitening.feast(v, 4.5, 9.5, 5)
    assert np.allclose(values, [5, 6, 7, 8, 9], atol=1e-12)
    with pytest.raises(ArithmeticError):
        whitening.feast(v, 4.5, 9.5, 6)
