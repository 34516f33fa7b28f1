"""Smoothing kernels as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Unary, col, log_gamma, num


def _bounded(x: Column, value: Column) -> Column:
    return F.when(F.abs(x) <= 1, value).otherwise(F.lit(0.0))


def uniform(x: Column) -> Column:
    return _bounded(x, F.lit(0.5))


def triangular(x: Column) -> Column:
    return _bounded(x, 1 - F.abs(x))


def epanechnikov(x: Column) -> Column:
    return _bounded(x, 0.75 * (1 - x * x))


def quartic(x: Column) -> Column:
    return _bounded(x, 15 / 16 * F.pow(1 - x * x, F.lit(2.0)))


def triweight(x: Column) -> Column:
    return _bounded(x, 35 / 32 * F.pow(1 - x * x, F.lit(3.0)))


def tricube(x: Column) -> Column:
    return _bounded(x, 70 / 81 * F.pow(1 - F.pow(F.abs(x), F.lit(3.0)), F.lit(3.0)))


def cosine(x: Column) -> Column:
    return _bounded(x, math.pi / 4 * F.cos(math.pi / 2 * x))


def hyperbolic_cosine(x: Column) -> Column:
    """``(2 - cosh(a x))`` scaled to integrate to one, zero at the ends."""
    a = math.acosh(2)
    return _bounded(x, (2 - F.cosh(a * x)) / (4 - 2 * math.sinh(a) / a))


def laplacian(x: Column) -> Column:
    return 0.5 * F.exp(-F.abs(x))


def silverman(x: Column) -> Column:
    z = F.abs(x) / math.sqrt(2)
    return 0.5 * F.exp(-z) * F.sin(z + math.pi / 4)


def gaussian(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


KERNELS: dict[str, Unary] = {
    f.__name__: f
    for f in (
        uniform, triangular, epanechnikov, quartic, triweight, tricube, cosine, hyperbolic_cosine, laplacian, silverman, gaussian,
    )
}


def spherical(xs: Column, p: int) -> Column:
    """Epanechnikov's kernel of the distance from the origin in ``p`` dimensions."""
    square = F.aggregate(col(xs), F.lit(0.0), lambda s, v: s + v * v)
    scale = math.gamma(2 + p / 2) / math.pi ** (p / 2)
    return F.when(square <= 1, scale * (1 - square)).otherwise(F.lit(0.0))


def product_one(xs: Column, kernel: Unary) -> Column:
    """One kernel for all coordinates, multiplied."""
    return F.aggregate(F.transform(col(xs), kernel), F.lit(1.0), lambda s, v: s * v)


def product_each(xs: Column, kernels: list[Unary]) -> Column:
    out = F.lit(1.0)
    for i, k in enumerate(kernels):
        out = out * k(F.get(col(xs), i))
    return out


def additive_bounded(xs: Column, kernel: Unary) -> Column:
    """Kernels of the coordinates added, as a density on the open cube."""
    n = F.size(col(xs)).cast("double")
    inside = F.forall(col(xs), lambda v: F.abs(v) < 1)
    total = F.aggregate(F.transform(col(xs), kernel), F.lit(0.0), lambda s, v: s + v)
    return F.when(inside, total / (n * F.pow(F.lit(2.0), n - 1))).otherwise(F.lit(0.0))


def product_bounded(xs: Column, kernels: list[Unary]) -> Column:
    inside = F.forall(col(xs), lambda v: F.abs(v) < 1)
    return F.when(inside, product_each(xs, kernels)).otherwise(F.lit(0.0))


def log_ball_volume(p: Column | float) -> Column:
    """Logarithm of the volume of the unit ball, for a column of dimensions."""
    p = num(p)
    return p / 2 * math.log(math.pi) - log_gamma(p / 2 + 1)
