"""Distances of a block of vectors from a block of queries, in NumPy.

The same distances as in ``distances``: ``x`` has a row for each vector, ``q`` one for
each query, both finite and of one length; the result has a row for each vector and a
column for each query.  Coordinates are added in their order, as the column
expressions add them.  A null is told by a mask: ``(values, mask)``.

A coordinate's part of some rows is worked out in place, in two buffers that stay in
the cache; what hangs on one vector alone (sizes, complements) is worked out before.

Some distances have a matrix product behind them, which is ten times as quick but adds
the coordinates in another order: ``Quick`` holds both, with a bound of the difference,
so that the callers take the product and work out again what the bound leaves open.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Values = np.ndarray | tuple[np.ndarray, np.ndarray]
BlockMetric = Callable[[np.ndarray, np.ndarray], Values]
#: Of a coordinate's column ``a`` and row ``b`` (several, if several are given for a
#: vector), in either of two buffers.
Part = Callable[..., np.ndarray]
#: Rows that are worked out at a time.
ROWS = 64


@dataclass(frozen=True)
class Quick:
    """A distance (``exact``) with a quick way: ``near`` gives values and how far they
    may be from those of ``exact``, NaN or infinite where that is not known.

    ``order`` gives, a row for each query, numbers that rise with the distance and one
    bound of theirs; ``pairs`` the values of ``exact`` of each row of ``x`` and the same
    row of ``q``."""

    exact: BlockMetric
    near: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | float]]
    order: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float]] | None = None
    pairs: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def __call__(self, x: np.ndarray, q: np.ndarray) -> Values:
        return self.exact(x, q)


def _slack(x: np.ndarray) -> float:
    """Twice what two sums of ``x``'s coordinates in other orders may differ by, as a share
    of the sum of sizes."""
    return 2 * (x.shape[1] + 8) * float(np.finfo(float).eps)


def total(x: np.ndarray, f: Callable[[np.ndarray], np.ndarray] = lambda v: v) -> np.ndarray:
    """Sum of ``f`` over the coordinates of each row."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += f(x[:, j])
    return out


def total2(x: np.ndarray | tuple[np.ndarray, ...], q: np.ndarray | tuple[np.ndarray, ...], f: Part, add: np.ufunc = np.add) -> np.ndarray:
    """Sum of ``f`` over the coordinates of each pair, or what ``add`` makes of them."""
    xs, qs = ([np.ascontiguousarray(v.T) for v in (m if isinstance(m, tuple) else (m,))] for m in (x, q))
    (d, n), m = xs[0].shape, qs[0].shape[1]
    out, buffers = np.zeros((n, m)), np.empty((2, min(ROWS, n), m))
    for at in range(0, n, ROWS):
        part = out[at : at + ROWS]
        t, u = buffers[:, : len(part)]
        rows = [v[:, at : at + ROWS, None] for v in xs]
        for j in range(d):
            add(part, f(*(v[j] for v in rows), *(v[j] for v in qs), t, u), out=part)
    return out


def _of(f: np.ufunc, a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``f(b, a)``: NumPy takes twice as long for a column and a row as for a copy of the
    row and a column."""
    np.copyto(out, b)
    return f(out, a, out=out)


def _less(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> np.ndarray:
    return np.abs(_of(np.subtract, a, b, t), out=t)


def _less_squared(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> np.ndarray:
    _of(np.subtract, a, b, t)
    return np.multiply(t, t, out=t)


def _plus(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> np.ndarray:
    return _of(np.add, a, b, t)


def _square(v: np.ndarray) -> np.ndarray:
    return v * v


def _ratio(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lost = b == 0
    with np.errstate(all="ignore"):
        return a / b, lost


def _squares(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by a product, and how far they may be off."""
    with np.errstate(all="ignore"):
        sx, sq = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
        out = x @ (-2 * q.T)
        out += sx[:, None]
        out += sq
        far = _slack(x) * (np.sqrt(sx.max(initial=0.0)) + np.sqrt(sq.max(initial=0.0))) ** 2
    return out, float(far)


def _root(squares: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray | float]:
    with np.errstate(all="ignore"):
        out = np.sqrt(np.maximum(squares, 0.0, out=squares), out=squares)
        # one bound will do where the least root is no small share of what may be
        least = out.min(initial=np.inf)
        return out, far / (least if least * least > 1e12 * far else out)


def _euclidean(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(total2(x, q, _less_squared))


euclidean = Quick(_euclidean, lambda x, q: _root(*_squares(x, q)), lambda x, q: _squares(q, x), lambda x, q: np.sqrt(total(x - q, _square)))


def manhattan(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return total2(x, q, _less)


def chebyshev(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return total2(x, q, _less, np.maximum)


def chebyshev_reference(x: np.ndarray, q: np.ndarray) -> Values:
    out = chebyshev(x[:, 1:], q[:, 1:])
    return (out, np.ones(out.shape, bool)) if x.shape[1] < 2 else out


def minkowski(p: float) -> BlockMetric:
    def part(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        _less(a, b, t, u)
        if p != int(p) or not 1 <= p <= 8:
            return np.power(t, p, out=t)
        np.copyto(u, t)
        for _ in range(int(p) - 1):
            np.multiply(u, t, out=u)
        return u

    return lambda x, q: total2(x, q, part) ** (1.0 / p)


def canberra(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    def part(a: np.ndarray, sa: np.ndarray, b: np.ndarray, sb: np.ndarray, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        np.add(_of(np.add, sa, sb, u), 1e-40, out=u)
        return np.divide(_less(a, b, t, u), u, out=t)

    return total2((x, np.abs(x)), (q, np.abs(q)), part)


def bray_curtis(x: np.ndarray, q: np.ndarray) -> Values:
    return _ratio(manhattan(x, q), total2(np.abs(x), np.abs(q), _plus))


def clark(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    zeros = bool((x == 0).any() and (q == 0).any())

    def part(a: np.ndarray, sa: np.ndarray, b: np.ndarray, sb: np.ndarray, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        _of(np.add, sa, sb, u)
        if zeros:
            np.copyto(u, 1.0, where=u == 0)  # both zero: equal
        np.divide(_of(np.subtract, a, b, t), u, out=t)
        return np.multiply(t, t, out=t)

    return np.sqrt(total2((x, np.abs(x)), (q, np.abs(q)), part))


def soergel(x: np.ndarray, q: np.ndarray) -> Values:
    return _ratio(manhattan(x, q), total2(np.abs(x), np.abs(q), lambda a, b, t, u: _of(np.maximum, a, b, t)))


def hassanat(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    def part(a: np.ndarray, a1: np.ndarray, a0: np.ndarray, b: np.ndarray, b1: np.ndarray, b0: np.ndarray, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        # 1 and the greater, less the smaller where it is negative
        np.subtract(_of(np.maximum, a1, b1, u), _of(np.minimum, a0, b0, t), out=u)
        return np.divide(_less(a, b, t, u), u, out=t)

    return total2(*((v, 1 + v, np.minimum(v, 0.0)) for v in (x, q)), part)


def _dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return total2(x, q, lambda a, b, t, u: _of(np.multiply, a, b, t))


def _near_dot(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    with np.errstate(all="ignore"):
        sizes = [np.sqrt(np.einsum("ij,ij->i", v, v).max(initial=0.0)) for v in (x, q)]
        return x @ q.T, float(_slack(x) * sizes[0] * sizes[1])


dot = Quick(_dot, _near_dot)


def _cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    size = np.sqrt(total(x, _square))[:, None] * np.sqrt(total(q, _square))
    c, lost = _ratio(_dot(x, q), size)
    return np.where(lost, 0.0, np.sqrt(np.maximum(0.0, 2 - 2 * c)))


def _near_cosine(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(all="ignore"):
        sizes = [np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, q)]
        # sizes whose squares leave the range of doubles have no bound
        held = all(1e-100 < v.min(initial=1.0) and v.max(initial=1.0) < 1e100 for v in sizes)
        c = (x / sizes[0][:, None]) @ (-2 * (q / sizes[1][:, None]).T)
        c += 2
        return _root(c, 4 * _slack(x) if held else np.nan)


cosine = Quick(_cosine, _near_cosine)


def pearson(x: np.ndarray, q: np.ndarray) -> Values:
    n = float(x.shape[1])
    mx, mq = total(x) / n, total(q) / n
    sxy = _dot(x, q) - (n * mx)[:, None] * mq
    sxx, sqq = total(x, _square) - n * mx * mx, total(q, _square) - n * mq * mq
    with np.errstate(invalid="ignore"):
        value, lost = _ratio(sxy, np.sqrt(sxx[:, None] * sqq))
    return 1 - value, lost


def aitchison_of_sizes(x: np.ndarray, q: np.ndarray) -> Values:
    """Aitchison's distance of the compositions that the sizes of the coordinates make;
    null where one is zero."""
    n = float(x.shape[1])
    lost = (x == 0).any(1)[:, None] | (q == 0).any(1)
    with np.errstate(all="ignore"):
        lx, lq = (np.log(np.abs(v) / total(v, np.abs)[:, None]) for v in (x, q))
        s = total2(lx, lq, lambda a, b, t, u: _of(np.subtract, a, b, t))
        ss = total2(lx, lq, _less_squared)
        return np.sqrt(np.maximum(0.0, n * ss - s * s)), lost


def fuzzy_hamming(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    x, q = np.clip(x, 0.0, 1.0), np.clip(q, 0.0, 1.0)
    if x.max(initial=0.0) + q.max(initial=0.0) < 1:  # then a < 1 - b and b < 1 - a
        return total2(x, q, lambda a, b, t, u: _of(np.maximum, a, b, t))

    def part(a: np.ndarray, a1: np.ndarray, b: np.ndarray, b1: np.ndarray, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        return np.maximum(_of(np.minimum, a, b1, t), _of(np.minimum, a1, b, u), out=t)

    return total2((x, 1 - x), (q, 1 - q), part)


def mahalanobis(sigma: np.ndarray) -> BlockMetric:
    """Of the leading coordinates, as many as ``sigma`` has."""
    inverse = np.linalg.inv(np.asarray(sigma, float))
    k = len(inverse)

    def distance(x: np.ndarray, q: np.ndarray) -> Values:
        if x.shape[1] < k:
            shape = (len(x), len(q))
            return np.zeros(shape), np.ones(shape, bool)
        d = [x[:, j, None] - q[:, j] for j in range(k)]
        out = np.zeros((len(x), len(q)))
        for a, row in zip(d, inverse, strict=True):
            out += a * sum((b * r for b, r in zip(d, row, strict=True)), 0.0)
        return np.sqrt(out)

    return distance


def steinhaus(pivot: float, metric: BlockMetric) -> BlockMetric:
    """Steinhaus transform by the point whose coordinates are all ``pivot``."""

    def distance(x: np.ndarray, q: np.ndarray) -> Values:
        at = np.full((1, x.shape[1]), pivot)
        d = metric(x, q)
        return _ratio(2 * d, d + metric(x, at) + metric(q, at)[:, 0])

    return distance


def outer_sum(k: int) -> BlockMetric:
    """Sum of the outer product of the leading ``k`` coordinates."""

    def value(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(q)))
        for j in range(min(k, x.shape[1])):
            for i in range(min(k, q.shape[1])):
                out += x[:, j, None] * q[:, i]
        return out

    return value


def less_sums(a: float) -> BlockMetric:
    """Sum of ``a`` less both coordinates."""
    return lambda x, q: total2(x, q, lambda v, w, t, u: np.subtract(a, _of(np.add, v, w, t), out=t))


def squared(factor: float) -> BlockMetric:
    def near(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
        value, far = _squares(x, q)
        return np.multiply(value, factor, out=value), 2 * abs(factor) * far

    return Quick(lambda x, q: factor * total2(x, q, _less_squared), near)
