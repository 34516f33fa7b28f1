"""Column expressions that the operators share; everything stays in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Unary = Callable[[Column], Column]
Binary = Callable[[Column, Column], Column]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(x: float | Column | str) -> Column:
    """A column as it is, a number as a double."""
    return F.lit(float(x)) if isinstance(x, (int, float)) else col(x)


def clean(c: Column | str) -> Column:
    """NaN is missing: null, which aggregates skip."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def null_nan(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def total(xs: Column | str, f: Unary = lambda v: v) -> Column:
    """Sum of ``f`` over an array."""
    return F.aggregate(col(xs), F.lit(0.0), lambda s, v: s + f(v))


def total2(xs: Column | str, ys: Column | str, f: Binary) -> Column:
    """Sum of ``f`` over two arrays of one length."""
    return F.aggregate(F.zip_with(col(xs), col(ys), f), F.lit(0.0), lambda s, v: s + v)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is zero."""
    return a / F.nullif(b, F.lit(0.0))


# Lanczos coefficients for g = 7.
_LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]


def log_gamma(x: Column | float) -> Column:
    """Logarithm of the gamma function, for positive arguments."""

    def direct(z: Column) -> Column:
        z = z - 1
        series = F.lit(_LANCZOS[0])
        for i, c in enumerate(_LANCZOS[1:], 1):
            series = series + F.lit(c) / (z + i)
        t = z + 7.5
        return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)

    x = num(x)
    # below one half by the recurrence, where the series loses digits
    return F.when(x > 0, F.when(x < 0.5, direct(x + 1) - F.log(x)).otherwise(direct(x)))


def erf(x: Column | float) -> Column:
    """Error function by its series of positive terms; 1 from 6 on."""
    x = num(x)
    z = F.abs(x)
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(160)),
        F.struct(z.alias("t"), z.alias("s")),
        lambda a, n: F.struct((a["t"] * 2 * z * z / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * 2 * z * z / (2 * n + 1)).alias("s")),
        lambda a: a["s"],
    )
    return F.when(z >= 6, F.signum(x)).otherwise(F.signum(x) * F.lit(2 / math.sqrt(math.pi)) * F.exp(-z * z) * step)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value worked out once, wherever and how often ``f``,
    or a loop in it, reads it."""
    return F.get(F.transform(F.array(value), f), 0)


def uniform(seed: int | Column, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on the keys and the seed only, not
    on how rows are partitioned: the first 52 bits of the MD5 digest of seed and
    keys as text, so that any SQL engine draws the same.  A null key is left out."""
    text = F.concat_ws("|", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def normal(seed: int | Column, *keys: Column | str) -> Column:
    """A standard normal number, likewise."""
    u = F.greatest(uniform(2 * seed, *keys), F.lit(1e-300))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(2 * seed + 1, *keys))


def integrate(f: Callable[[Column], Column], panels: int = 100) -> Column:
    """Simpson's rule on [0, 1]."""
    h = 1.0 / panels
    weight = lambda i: F.when((i == 0) | (i == panels), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    grid = F.sequence(F.lit(0), F.lit(panels))
    return F.aggregate(grid, F.lit(0.0), lambda s, i: s + weight(i) * f(i * h)) * (h / 3)
