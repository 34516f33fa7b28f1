from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from sparkwell.llm import whitening as wh

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, w string, at int").repartition(3)


def brute(rows, k=8):
    """Exact covariance by fractions, eigenvectors in extended precision by inverse steps."""
    good = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * Fraction(float(np.float32(c)))) + 100_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    cov = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(d)] for i in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    e, u = np.linalg.eigh(np.array(cov, float))
    return [i for i, _ in good], n, dev, cov, e[::-1][:k], u[:, ::-1][:, :k], np.array([[float(Fraction(n * v - t, n)) for v, t in zip(r, s, strict=True)] for r in x])


def test_against_fractions(spark):
    r = np.random.default_rng(3)
    mix = r.normal(size=(12, 12)) * np.geomspace(1, 0.01, 12)
    rows = [(i, [float(v) for v in (r.normal(size=12) @ mix + 5)], "w", i) for i in range(300)]
    rows += [(7, rows[7][1], "again", 0), (None, rows[8][1], None, None)]  # a repeated row, no id
    rows += [(400, None, "", 0), (401, [None] + [1.0] * 11, "", 0), (402, [math.nan] + [1.0] * 11, "", 0), (403, [math.inf] + [1.0] * 11, "", 0), (404, [], "", 0), (405, [1.0, 2.0], "", 0)]
    ids, n, dev, cov, e, u, y = brute([x for x in rows if x[1] is None or len(x[1]) == 12])
    out = wh.whiten(frame(spark, rows)).collect()
    assert [*out[0].asDict()] == COLUMNS and len(out) == 8 * n == 8 * 302
    assert {x.n for x in out} == {n}
    assert sorted({(x.vec_id is None, x.vec_id or 0, x.deviation) for x in out}) == sorted({(i is None, i or 0, v) for i, v in zip(ids, dev, strict=True)})
    trace = float(sum(cov[j][j] for j in range(12)))
    for c in range(8):
        got = {x.vec_id: x for x in out if x.component == c + 1}
        want = y @ u[:, c] / math.sqrt(e[c])
        w = np.array([got[i].whitened for i in ids])
        assert np.allclose(w * np.sign(w @ want), want, rtol=1e-9, atol=1e-10)
        assert got[0].explained == pytest.approx(e[c] / trace, rel=1e-12)
        assert got[0].identity_error < 1e-12


def test_edges(spark):
    assert wh.whiten(frame(spark, [])).count() == 0
    assert wh.whiten(frame(spark, [(1, None, "", 1), (2, [math.nan, 1.0], "", 1)])).count() == 0
    one = wh.whiten(frame(spark, [(1, [1.0, 2.0, 3.0], "", 1)])).collect()
    assert [(x.component, x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in sorted(one, key=lambda x: x.component)] == [(i, 1, 0, None, None, None) for i in (1, 2, 3)]
    # two points: one component, the others have no spread
    two = wh.whiten(frame(spark, [(1, [0.0, 0.0], "", 1), (2, [3.0, 4.0], "", 1)])).collect()
    assert sorted(abs(x.whitened) for x in two if x.component == 1) == pytest.approx([1, 1])
    assert {x.whitened for x in two if x.component == 2} == {None}
    # of two lengths equally common the longer
    mixed = wh.whiten(frame(spark, [(1, [1.0], "", 1), (2, [3.0, 4.0], "", 1)])).collect()
    assert {x.vec_id for x in mixed} == {2}
    large = wh.whiten(frame(spark, [(1, [1e30, 1.0], "", 1), (2, [2.0**30, 0.0], "", 1), (3, [0.0, 1.0], "", 1)])).collect()
    assert {x.vec_id for x in large} == {2, 3} and {x.deviation for x in large} == {None}


def test_outer_sums_keep_what_doubles_lose(spark):
    r = np.random.default_rng(5)
    high = r.normal(size=(5000, 4)) * 10.0 ** r.integers(-6, 6, size=(5000, 4))
    low = high * 2.0**-55 * r.normal(size=high.shape)
    a, b = wh.outer_sum(high, low)
    rows = [[Fraction(h) + Fraction(w) for h, w in zip(x, y, strict=True)] for x, y in zip(high.tolist(), low.tolist(), strict=True)]
    for i in range(4):
        for j in range(4):
            exact = sum(x[i] * x[j] for x in rows)
            size = sum(abs(x[i] * x[j]) for x in rows)
            assert abs(Fraction(float(a[i, j])) + Fraction(float(b[i, j])) - exact) < size * Fraction(1, 2**80)


def test_eigenvectors_to_the_last_bits():
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.normal(size=(40, 40)))
    e = np.geomspace(1, 1e-6, 40)
    q = q.astype(np.longdouble)
    for _ in range(3):  # orthogonal to extended precision
        q = q @ (1.5 * np.eye(40) - 0.5 * (q.T @ q))
    values, vectors = wh.eigen((q * e) @ q.T)
    assert np.allclose(values, e, rtol=1e-12)
    for j in range(40):
        assert abs(abs(float(vectors[:, j] @ q[:, j])) - 1) < 1e-15
        off = vectors[:, j] * np.sign(float(vectors[:, j] @ q[:, j])) - q[:, j].astype(float)
        assert np.abs(off).max() < 1e-12


def test_deviation_of_long_sums():
    x = np.array([[1 << 40, 0], [5, 7]])
    got = wh._deviation(x, 3, x.sum(axis=0))
    want = [sum((3 * int(v) - int(t)) ** 2 for v, t in zip(row, x.sum(axis=0), strict=True)) for row in x]
    assert got == [v if v < 1 << 63 else None for v in want]
