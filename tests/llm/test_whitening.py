"""Spectrum slicing against numpy's own eigensolver and exact arithmetic."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("tarnish.llm.queries")

from tarnish.llm import op11_whitening as op  # noqa: E402
from tarnish.llm.common import importable  # noqa: E402

SCHEMA = "vec_id bigint, embedding array<float>, label int, x int, component string, n string"


def frame(spark, vectors):
    importable(spark)
    return spark.createDataFrame([(i, v, 1, 2, "c", None) for i, v in vectors], SCHEMA).repartition(3)


def expected(vectors):
    """vec_id -> (deviation, whitened by component up to sign), explained by component, of vectors of one length."""
    whole = {}
    for i, v in vectors:
        if v and all(c is not None and math.isfinite(c) for c in v):
            whole.setdefault(i, []).append(tuple(math.floor(256 * float(np.float32(c))) for c in v))
    fit = sorted({v for rows in whole.values() for v in rows})
    n = len(fit)
    s = [sum(c) for c in zip(*fit)]
    x = np.array(fit, float) - np.array([float(Fraction(c, n)) for c in s])
    e, u = np.linalg.eigh(x.T @ x / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    out = {i: [(sum((n * a - b) ** 2 for a, b in zip(v, s)), (np.array(v) - np.array(s) / n) @ u / np.sqrt(e)) for v in rows]
           for i, rows in whole.items()}
    return n, out, e / np.trace(x.T @ x / n)


@pytest.mark.parametrize("d", [1, 3, 6, 40])
def test_leading_equals_an_eigensolver(d):
    rng = np.random.default_rng(d)
    for values in (rng.random(d), np.ones(d), 10.0 ** -np.arange(d), np.r_[np.ones(min(d, 2)), np.zeros(max(0, d - 2))]):
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        m = (q * values) @ q.T
        m = (m + m.T) / 2
        e, u = op.leading(m, 4)
        assert len(e) == min(4, int((values > 1e-13 * values.sum()).sum()))
        assert np.allclose(e, np.sort(values)[::-1][:len(e)], atol=1e-13)
        assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-13) and np.allclose(m @ u, u * e, atol=1e-13)


def test_factor_counts_and_solves():
    rng = np.random.default_rng(5)
    for d in (1, 2, 5, 30):
        for _ in range(20):
            m = rng.standard_normal((d, d))
            m = m + m.T
            if d == 5:
                m[np.diag_indices(d)] = 0  # needs pivots of two rows
            f = op.Factor(m)
            assert f.positive() == (np.linalg.eigvalsh(m) > 0).sum()
            b = rng.standard_normal(d)
            assert np.allclose(m @ f.solve(b), b, atol=1e-6)


def test_whitening_against_exact_arithmetic(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 0.1 * (k + 1)) for k in range(7)]) for i in range(300)]
    vectors += [(300, None), (301, [0.1] * 6 + [None]), (302, [float("nan")] * 7), (303, [float("inf")] + [0.0] * 6),
                (304, [-0.0] * 7), (305, [0.0] * 7), (None, [0.25] * 7), (5, vectors[5][1]), (5, vectors[6][1]), (306, [])]
    got = op.whitened(frame(spark, vectors)).collect()
    n, want, explained = expected(vectors)
    assert len(got) == 4 * sum(map(len, want.values()))
    by = {}
    for r in got:
        assert r["n"] == n and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    assert {k[0] for k in by} == set(want)
    signs = None
    for i, rows in want.items():
        for deviation, y in rows:
            found = np.array([by[i, deviation][c][0] for c in (1, 2, 3, 4)])
            signs = np.sign(found * y) if signs is None else signs
            assert np.allclose(found * signs, y, atol=1e-9)


def test_whitening_of_ranks_lengths_and_nothing(spark):
    assert op.whitened(frame(spark, [])).collect() == []
    assert op.whitened(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []  # no variance: nothing to divide by
    line = [(i, [0.01 * i, 0.02 * i]) for i in range(0, 100, 4)]
    flat = op.whitened(frame(spark, [(i, [v[0], 0.5]) for i, v in line])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == len(line)
    both = op.whitened(frame(spark, [(i, [v[0], 0.5]) for i, v in line] + [(1000 + i, [0.1 * i]) for i in range(9)])).collect()
    assert sorted(tuple(r)[:5] for r in both if r["vec_id"] < 1000) == sorted(tuple(r)[:5] for r in flat)
    assert {r["n"] for r in both if r["vec_id"] >= 1000} == {9}


def test_deviations_beyond_a_long_are_null():
    space = op.Space(10 ** 9, [0, 5], np.ones(1), np.ones((2, 1)), 1.0)
    assert op.deviations(np.array([[10 ** 6, 3], [1, 0]]), space) == [None, 10 ** 18 + 25]
