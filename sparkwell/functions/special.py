"""Scalar mathematics: factorials, finite differences, series, splines, errors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Unary, col, log_gamma, normal, num, uniform

Num = Column | float


def factorial(x: Num) -> Column:
    return F.exp(log_gamma(num(x) + 1))


def stirling(x: Num) -> Column:
    x = num(x)
    return F.sqrt(2 * math.pi * x) * F.pow(x / math.e, x)


def gosper(x: Num) -> Column:
    x = num(x)
    return F.sqrt((2 * x + 1 / 3) * math.pi) * F.pow(x / math.e, x)


def log_beta(a: Num, b: Num) -> Column:
    a, b = num(a), num(b)
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def beta(a: Num, b: Num) -> Column:
    return F.exp(log_beta(a, b))


def binom_coefficient(n: Num, k: Num) -> Column:
    n, k = num(n), num(k)
    return F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1))


def absolute_error(approx: Num, truth: Num) -> Column:
    """Signed."""
    return num(approx) - num(truth)


def relative_error(approx: Num, truth: Num) -> Column:
    return (num(approx) - num(truth)) / F.nullif(num(truth), F.lit(0.0))


def approx_value(truth: Num, relative: Num) -> Column:
    return num(truth) * (1 + num(relative))


def jl_dimension(eps: Num, n: Num) -> Column:
    """Johnson-Lindenstrauss: dimensions that keep ``n`` points within ``eps``."""
    return F.ceil(8 * F.log(num(n)) / (num(eps) * num(eps))).cast("long")


def jl_epsilon(m: Num, n: Num) -> Column:
    return F.sqrt(8 * F.log(num(n)) / num(m))


def jl_bounds(eps: Num, x: Column, y: Column) -> Column:
    """Array of the lower and upper bound of the squared distance."""
    d = F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return F.array((1 - num(eps)) * d, (1 + num(eps)) * d)


# Finite differences.  ``side``: -1 backward, 0 central, 1 forward, or between.


def deriv1(f: Unary, x: Num, h: float = 1e-5, side: float = 0.0) -> Column:
    x = num(x)
    return (f(x + h * (1 + side) / 2) - f(x - h * (1 - side) / 2)) / h


def deriv2(f: Unary, x: Num, h: float = 1e-4, side: float = 0.0) -> Column:
    x = num(x) + side * h
    return (f(x + h) - 2 * f(x) + f(x - h)) / (h * h)


def deriv(f: Unary, x: Num, p: int, h: float = 1e-2, side: float = 0.0) -> Column:
    """``p``-th derivative by differences of binomial weights."""
    x = num(x)
    out = F.lit(0.0)
    for j in range(p + 1):
        out = out + (-1) ** (p - j) * math.comb(p, j) * f(x + (j - p / 2 + side * p / 2) * h)
    return out / h**p


def gradient(f: Callable[[np.ndarray], float], x: np.ndarray, h: float = 1e-5, side: float = 0.0) -> np.ndarray:
    """Of a driver-side function; ``f`` may run a job."""
    x = np.asarray(x, float)
    steps = h * np.eye(len(x))
    return np.array([(f(x + (1 + side) / 2 * e) - f(x - (1 - side) / 2 * e)) / h for e in steps])


def directional_derivative(f: Callable[[np.ndarray], float], x: np.ndarray, direction: np.ndarray, h: float = 1e-5, side: float = 0.0) -> float:
    d = np.asarray(direction, float)
    d = d / np.linalg.norm(d)
    x = np.asarray(x, float)
    return float((f(x + (1 + side) / 2 * h * d) - f(x - (1 - side) / 2 * h * d)) / h)


def hessian(f: Callable[[np.ndarray], float], x: np.ndarray, h: float = 1e-4) -> np.ndarray:
    x = np.asarray(x, float)
    e = h * np.eye(len(x))
    return np.array(
        [[(f(x + a + b) - f(x + a - b) - f(x - a + b) + f(x - a - b)) / (4 * h * h) for b in e] for a in e]
    )


# Series.  Coefficients are found on the driver; evaluation is an expression.


def taylor_coefficients(f: Callable[[float], float], p: int, at: float = 0.0, h: float = 1e-2) -> list[float]:
    """Derivatives 0 to ``p`` over their factorials, by central differences."""
    out = []
    for k in range(p + 1):
        d = sum((-1) ** (k - j) * math.comb(k, j) * f(at + (j - k / 2) * h) for j in range(k + 1)) / h**k
        out.append(d / math.factorial(k))
    return out


def maclaurin_coefficients(f: Callable[[float], float], p: int) -> list[float]:
    return taylor_coefficients(f, p)


def eval_power_series(x: Num, coefficients: list[float], at: float = 0.0) -> Column:
    """Horner's rule on ``x - at``."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * (num(x) - at) + c
    return out


def fourier_coefficients(f: Callable[[np.ndarray], np.ndarray], p: int, steps: int = 10_000) -> np.ndarray:
    """Rows ``(a_k, b_k)`` for k = 0..p on [-pi, pi], by the mid-point rule."""
    t = (np.arange(steps) + 0.5) * 2 * np.pi / steps - np.pi
    k = np.arange(p + 1)[:, None]
    y = f(t)
    return np.column_stack([(y * np.cos(k * t)).mean(1) * 2, (y * np.sin(k * t)).mean(1) * 2]) * np.where(k == 0, 0.5, 1)


def eval_fourier(x: Num, coefficients: np.ndarray) -> Column:
    x = num(x)
    out = F.lit(0.0)
    for k, (a, b) in enumerate(coefficients):
        out = out + float(a) * F.cos(k * x) + float(b) * F.sin(k * x)
    return out


def bspline_basis(x: Num, i: int, order: int, knots: list[float]) -> Column:
    """Cox and de Boor's recursion; order 1 is a step.  Empty intervals give zero."""
    x = num(x)
    if order == 1:
        return F.when((x >= knots[i]) & (x < knots[i + 1]), 1.0).otherwise(F.lit(0.0))
    out = F.lit(0.0)
    if (d := knots[i + order - 1] - knots[i]) > 0:
        out = out + (x - knots[i]) / d * bspline_basis(x, i, order - 1, knots)
    if (d := knots[i + order] - knots[i + 1]) > 0:
        out = out + (knots[i + order] - x) / d * bspline_basis(x, i + 1, order - 1, knots)
    return out


def cubic_basis(x: Num, knot: float, right: bool = True) -> Column:
    """Truncated cube."""
    z = F.greatest(F.lit(0.0), (num(x) - knot) * (1 if right else -1))
    return z * z * z


def bernstein(x: Num, values: Column) -> Column:
    """Bernstein polynomial of the values at equal steps of [0, 1]; null outside."""
    x, n = num(x), F.size(values) - 1
    term = lambda v, i: v * binom_coefficient(n.cast("double"), i.cast("double")) * F.pow(x, i.cast("double")) * F.pow(1 - x, (n - i).cast("double"))
    return F.when((x >= 0) & (x <= 1), F.aggregate(F.transform(values, term), F.lit(0.0), lambda s, v: s + v))


def bernstein_poly(x: Num, f: Unary, n: int) -> Column:
    return bernstein(x, F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: f(i / n)))


def eval_poly(x: Num, coefficients: Column) -> Column:
    """Sum of ``c_i x^i / i!``."""
    x = num(x)
    term = lambda c, i: c * F.pow(x, i.cast("double")) / F.exp(log_gamma(i.cast("double") + 1))
    return F.aggregate(F.transform(col(coefficients), term), F.lit(0.0), lambda s, v: s + v)


def hard_clip(x: Column, bound: float) -> Column:
    return F.least(F.lit(float(bound)), F.greatest(F.lit(-float(bound)), x))


def soft_clip(x: Column, bound: float) -> Column:
    return bound * F.tanh(x / bound)


def clamp(x: Column, low: Num, high: Num) -> Column:
    return F.greatest(num(low), F.least(num(high), x))


def norm_coefficients(p: int, seed: int, *keys) -> Column:
    return F.array(*[normal(seed * 1009 + i, *keys) for i in range(p + 1)])


def spike_slab_coefficients(p: int, seed: int, *keys) -> Column:
    """Normal with a probability of three quarters, else zero."""
    return F.array(
        *[
            F.when(uniform(seed * 2003 + i, *keys) < 0.75, normal(seed * 1009 + i, *keys)).otherwise(F.lit(0.0))
            for i in range(p + 1)
        ]
    )


# Bits.


def pack_bits(flags: Column) -> Column:
    """Up to 64 flags (or numbers of a half or more), first lowest, as a long; 0
    for more."""
    bit = F.transform(flags, lambda v, i: F.when(v.cast("double") >= 0.5, F.expr("1L")).otherwise(F.expr("0L")))
    packed = F.aggregate(
        F.reverse(bit), F.lit(0).cast("long"), lambda s, v: F.shiftleft(s, 1).bitwiseOR(v)
    )
    return F.when(F.size(flags) > 64, F.lit(0).cast("long")).otherwise(packed)


def unpack_bits(x: Column, width: int = 64) -> Column:
    """The lowest ``width`` bits as an array, lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(x.cast("long"), i).cast("int"))
