"""Distances and norms of ``array<double>`` columns.

Each function takes column expressions and returns one; nothing is exploded.
``mode="reference"`` gives the variant of the original programs where that is
well defined and differs from the textbook.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Unary, col, integrate, ratio, total, total2

Metric = Callable[[Column, Column], Column]


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(total2(x, y, lambda a, b: (a - b) * (a - b)))


def manhattan(x: Column, y: Column) -> Column:
    return total2(x, y, lambda a, b: F.abs(a - b))


def chebyshev(x: Column, y: Column, mode: str = "standard") -> Column:
    """Greatest coordinate difference; the reference leaves out the first one."""
    d = F.zip_with(col(x), col(y), lambda a, b: F.abs(a - b))
    return F.array_max(F.slice(d, 2, 1 << 30) if mode == "reference" else d)


def minkowski(x: Column, y: Column, p: float, mode: str = "standard") -> Column:
    if p == float("inf"):
        return chebyshev(x, y, mode)
    return F.pow(total2(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(float(p)))), F.lit(1.0 / p))


def canberra(x: Column, y: Column) -> Column:
    return total2(x, y, lambda a, b: F.abs(a - b) / (F.abs(a) + F.abs(b) + 1e-40))


def bray_curtis(x: Column, y: Column) -> Column:
    return ratio(manhattan(x, y), total2(x, y, lambda a, b: F.abs(a) + F.abs(b)))


def clark(x: Column, y: Column) -> Column:
    """Coordinates that are zero in both count as equal."""
    part = lambda a, b: F.coalesce(ratio(a - b, F.abs(a) + F.abs(b)), F.lit(0.0))
    return F.sqrt(total2(x, y, lambda a, b: part(a, b) * part(a, b)))


def soergel(x: Column, y: Column) -> Column:
    return ratio(manhattan(x, y), total2(x, y, lambda a, b: F.greatest(F.abs(a), F.abs(b))))


def hassanat(x: Column, y: Column) -> Column:
    """A negative minimum shifts both ends to zero."""

    def part(a: Column, b: Column) -> Column:
        low = F.least(a, b)
        return F.abs(a - b) / (1 + F.greatest(a, b) + F.when(low < 0, F.abs(low)).otherwise(F.lit(0.0)))

    return total2(x, y, part)


def dot(x: Column, y: Column) -> Column:
    return total2(x, y, lambda a, b: a * b)


def cosine(x: Column, y: Column) -> Column:
    """Length of the chord between the directions."""
    c = ratio(dot(x, y), l2_norm(x) * l2_norm(y))
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * c))


def pearson(x: Column, y: Column) -> Column:
    n = F.size(col(x)).cast("double")
    mx, my = total(x) / n, total(y) / n
    sxy = dot(x, y) - n * mx * my
    sxx, syy = dot(x, x) - n * mx * mx, dot(y, y) - n * my * my
    return 1 - ratio(sxy, F.sqrt(sxx * syy))


def aitchison(x: Column, y: Column, tol: float = 1e-10) -> Column:
    """Of two compositions (positive, sum one), with every pair of parts counted
    once; null for others."""
    n = F.size(col(x)).cast("double")
    d = F.zip_with(col(x), col(y), lambda a, b: F.log(a) - F.log(b))
    ok = (F.abs(total(x) - 1) < tol) & (F.abs(total(y) - 1) < tol) & (F.array_min(col(x)) > 0) & (F.array_min(col(y)) > 0)
    return F.when(ok, F.sqrt(F.greatest(F.lit(0.0), n * total(d, lambda v: v * v) - total(d) * total(d))))


def fuzzy_hamming(x: Column, y: Column) -> Column:
    """Sum over coordinates of the fuzzy exclusive or, after clamping to [0, 1]."""
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return total2(
        x, y, lambda a, b: F.greatest(F.least(clamp(a), 1 - clamp(b)), F.least(1 - clamp(a), clamp(b)))
    )


def hamming_bits(x: Column, y: Column) -> Column:
    """Different bits of two byte strings over the length of the shorter one."""
    n = F.least(F.octet_length(x), F.octet_length(y))
    at = lambda s, i: F.conv(F.hex(F.substring(s.cast("binary"), i, F.lit(1))), 16, 10).cast("int")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.bit_count(at(x, i).bitwiseXOR(at(y, i))))
    return F.when(n > 0, F.aggregate(each, F.lit(0), lambda s, v: s + v)).otherwise(F.lit(0)).cast("long")


def mahalanobis(x: Column, y: Column, sigma: np.ndarray) -> Column:
    """With the covariance matrix ``sigma``, inverted on the driver."""
    inverse = np.linalg.inv(np.asarray(sigma, float))
    d = F.zip_with(col(x), col(y), lambda a, b: a - b)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in inverse])
    return F.sqrt(F.aggregate(F.zip_with(d, rows, lambda a, r: a * dot(d, r)), F.lit(0.0), lambda s, v: s + v))


def l0_norm(x: Column) -> Column:
    return F.size(F.filter(col(x), lambda v: F.abs(v) > 1e-15)).cast("long")


def l1_norm(x: Column) -> Column:
    return total(x, F.abs)


def l2_norm(x: Column) -> Column:
    return F.sqrt(total(x, lambda v: v * v))


def linf_norm(x: Column) -> Column:
    return F.array_max(F.transform(col(x), F.abs))


def lp_norm(x: Column, p: float) -> Column:
    return F.pow(total(x, lambda v: F.pow(F.abs(v), F.lit(float(p)))), F.lit(1.0 / p))


def steinhaus(x: Column, y: Column, pivot: Column, metric: Metric) -> Column:
    """Steinhaus transform of a metric by a pivot."""
    d = metric(x, y)
    return ratio(2 * d, d + metric(x, pivot) + metric(y, pivot))


# Of densities on [0, 1], given as functions of a column.


def hellinger(f: Unary, g: Unary) -> Column:
    return F.sqrt(F.abs(1 - integrate(lambda t: F.sqrt(f(t) * g(t)))))


def bhattacharyya(f: Unary, g: Unary) -> Column:
    return F.abs(-F.log(integrate(lambda t: F.sqrt(f(t) * g(t)))))


def jeffreys(f: Unary, g: Unary) -> Column:
    """Squared Matusita form."""
    return integrate(lambda t: (F.sqrt(f(t)) - F.sqrt(g(t))) * (F.sqrt(f(t)) - F.sqrt(g(t))))


def jensen_shannon(f: Unary, g: Unary) -> Column:
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log(2 * a / (a + b))).otherwise(F.lit(0.0))

    return F.sqrt(integrate(lambda t: part(f(t), g(t)) + part(g(t), f(t))))


def steinhaus_density(f: Unary, g: Unary, h: Unary, distance: Callable[[Unary, Unary], Column]) -> Column:
    d = distance(f, g)
    return ratio(2 * d, d + distance(f, h) + distance(g, h))
