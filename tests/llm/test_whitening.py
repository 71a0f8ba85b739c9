"""Whitening against a plain eigendecomposition of the exact covariance."""

import math
import random

import numpy as np
import pytest

from lossworks.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label string, x string, ident string"


def plain(rows):
    """(n, sums, covariance, eigenvalues, eigenvectors, numbers by row)."""
    d = max(len(v) for _, v in rows)
    numbers = [(i, tuple([math.floor(float(np.float32(c)) * 256) for c in v] + [0] * (d - len(v)))) for i, v in rows]
    fit = np.array(sorted({x for _, x in numbers}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit * n - s).astype(float) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    return n, s, v, values[::-1], vectors[:, ::-1], numbers


def check(spark, rows, extra=()):
    df = spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in (*rows, *extra)], SCHEMA).repartition(3)
    n, s, v, values, vectors, numbers = plain(rows)
    c = min(4, len(values))
    got = whitening.whitened(df).collect()
    assert len(got) == c * len(rows)
    found: dict = {}
    for r in got:
        found.setdefault(r.component, []).append(r)
    for k in range(1, c + 1):
        own = sorted(found[k], key=lambda r: (r.vec_id is None, r.vec_id, r.deviation_exact))
        expected = sorted(((i, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), x) for i, x in numbers), key=lambda r: (r[0] is None, r[0], r[1]))
        assert [(r.vec_id, int(r.deviation_exact), r.n) for r in own] == [(i, y, n) for i, y, _ in expected]
        assert all(r.deviation == (int(r.deviation_exact) if r.deviation_exact < 2**63 else None) for r in own)
        gap = min([abs(values[k - 1] - e) for j, e in enumerate(values) if j != k - 1], default=1)
        if values[k - 1] <= values[0] * 1e-13:
            assert all(r.whitened is None for r in own)
            continue
        near = 1e-9 if values[c - 1] > values[0] * 1e-6 else 1e-4  # rounding errors are a share of the largest eigenvalue
        assert all(abs(r.explained - values[k - 1] / np.trace(v)) <= near * r.explained for r in own)
        assert all(r.identity_error < near for r in own)
        if gap > 1e-6 * values[0]:
            w = np.array([(np.array(x, float) - np.array(s, float) / n) @ vectors[:, k - 1] for _, _, x in expected]) / math.sqrt(values[k - 1])
            mine = np.array([r.whitened for r in own])
            sign = 1 if (w * mine).sum() > 0 else -1
            assert np.abs(w - sign * mine).max() < 1e-7


def vectors(n, d, seed=1, scales=None):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, d)) * (np.ones(d) if scales is None else scales)


def test_flat_spectrum_with_copies_and_bad_rows(spark):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors(400, 30))]
    rows += [(1000 + k, rows[5][1]) for k in range(300)] + [(5, rows[5][1]), (None, rows[6][1])]
    check(spark, rows, [(1, None), (2, [float("nan")] * 30), (3, [None] + [0.0] * 29), (4, [float("-inf")] + [0.0] * 29)])


def test_steep_spectrum(spark):
    check(spark, [(i, [float(c) for c in v]) for i, v in enumerate(vectors(300, 40, 2, 2.0 ** -np.arange(40.0)))])


def test_few_dimensions_and_ranks(spark):
    check(spark, [(i, [float(c) for c in v]) for i, v in enumerate(vectors(50, 3))])
    check(spark, [(i, [float(c)]) for i, c in enumerate(range(9))])
    base = vectors(2, 20, 4)
    check(spark, [(i, [float(c) for c in np.float32(base[0] * (i % 7) + base[1] * 64 * (i % 3))]) for i in range(40)])


def test_no_variation(spark):
    rows = whitening.whitened(spark.createDataFrame([(k, [1.5, 2.5], "", "", "") for k in range(3)], SCHEMA)).collect()
    assert len(rows) == 6
    assert all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_fit(spark, rows):
    assert whitening.whitened(spark.createDataFrame([(i, v, "", "", "") for i, v in rows], SCHEMA)).count() == 0


def test_shorter_vectors_have_zeros_behind(spark):
    rng = random.Random(3)
    check(spark, [(i, [rng.uniform(-1, 1) for _ in range(rng.choice((0, 3, 6)))]) for i in range(60)])


def test_large_numbers_stay_exact(spark):
    check(spark, [(i, [float(c) for c in np.float32(v * 2.0**40)]) for i, v in enumerate(vectors(40, 5))])


def test_a_missed_direction_is_found():
    """The start has nothing of the largest direction but rounding errors; what the trace leaves shows it."""
    d = 60
    values = np.sort(np.r_[np.linspace(0.5, 1, d - 5), 3, 4, 5, 6, 7.0])[::-1]
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))[0]
    v = (turn * values) @ turn.T
    passes = []

    def times(q):
        passes.append(q.shape[1])
        return v @ q

    got, vectors_ = whitening.leading(times, d, 4, lambda: float(np.trace(v)))
    assert np.allclose(got, values[:4], rtol=1e-13)
    assert np.allclose(np.abs(np.sum(vectors_ * turn[:, :4], axis=0)), 1, atol=1e-12)
    assert len(passes) < 80


def test_filter_damps_the_unwanted_part():
    values = np.linspace(0, 1, 41)
    v = np.diag(np.r_[values, 2.0])
    q = np.eye(42)
    out = np.diag(whitening.filtered(lambda a: v @ a, q, v @ q, 1.0, 2.0))
    assert abs(out[-1] - 1) < 1e-9
    assert np.abs(out[:-1]).max() < 1e-5


def test_equal_eigenvalues_end():
    v = np.diag([5.0, 5, 5, 5, 5, 5, *([1.0] * 30)])
    got, q = whitening.leading(lambda a: v @ a, 36, 4, lambda: float(np.trace(v)))
    assert np.allclose(got, 5) and np.allclose(q.T @ q, np.eye(4))
