"""Arithmetic of ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Binary, Unary, num, total, total2

Num = Column | float


def zeros(x: Column) -> Column:
    return F.transform(x, lambda _: F.lit(0.0))


def ones(x: Column) -> Column:
    return F.transform(x, lambda _: F.lit(1.0))


def neg(x: Column) -> Column:
    return F.transform(x, lambda v: -v)


def inv(x: Column, by_zero: float | None = None) -> Column:
    """Reciprocals; of numbers below 1e-12 in size ``by_zero`` (null by default)."""
    other = F.lit(by_zero).cast("double")
    return F.transform(x, lambda v: F.when(F.abs(v) < 1e-12, other).otherwise(1 / F.nullif(v, F.lit(0.0))))


def apply(x: Column, f: Unary) -> Column:
    return F.transform(x, f)


def norm(x: Column) -> Column:
    return F.sqrt(total(x, lambda v: v * v))


def normalize(x: Column) -> Column:
    return F.transform(x, lambda v: v / F.nullif(norm(x), F.lit(0.0)))


def sum_of(x: Column) -> Column:
    return total(x)


def mean(x: Column) -> Column:
    return total(x) / F.nullif(F.size(x), F.lit(0))


def scalar(a: Num, x: Column, f: Binary) -> Column:
    """``f(a, v)`` of each element; addition, subtraction and so on are cases."""
    return F.transform(x, lambda v: f(num(a), v))


def elementwise(x: Column, y: Column, f: Binary) -> Column:
    return F.zip_with(x, y, f)


def divide(x: Column, y: Column, by_zero: float | None = None) -> Column:
    other = F.lit(by_zero).cast("double")
    return F.zip_with(x, y, lambda a, b: F.when(F.abs(b) < 1e-12, other).otherwise(a / F.nullif(b, F.lit(0.0))))


def dot(x: Column, y: Column) -> Column:
    return total2(x, y, lambda a, b: a * b)


def outer(x: Column, y: Column) -> Column:
    return F.transform(x, lambda a: F.transform(y, lambda b: a * b))


def outer_flat(x: Column, y: Column, column_major: bool = False) -> Column:
    return F.flatten(outer(y, x) if column_major else outer(x, y))


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(total2(x, y, lambda a, b: (a - b) * (a - b)))


def det2(m: Column) -> Column:
    """Of a row-major array of four."""
    a = [F.get(m, i) for i in range(4)]
    return a[0] * a[3] - a[1] * a[2]


def det3(m: Column) -> Column:
    a = [F.get(m, i) for i in range(9)]
    return (
        a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])
    )
