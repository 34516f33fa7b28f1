"""Descriptive statistics: each is one aggregation, with partial sums before the
shuffle, over all rows or by groups.

Numbers are doubles; NaN and null are missing.  A group without values gives
null.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Unary, clean, num, ratio


def mean(x) -> Column:
    return F.avg(clean(x))


def geometric_mean(x) -> Column:
    """Of positive numbers, by logarithms; null if one is not positive."""
    x = clean(x)
    return F.when(F.min(x) > 0, F.exp(F.avg(F.log(x))))


def geometric_mean_product(x) -> Column:
    x = clean(x)
    return F.pow(F.product(x), 1 / F.nullif(F.count(x), F.lit(0)))


def harmonic_mean(x, mode: str = "standard") -> Column:
    """The reference's denominator starts at one."""
    x = clean(x)
    return ratio(F.count(x).cast("double"), F.sum(1 / F.nullif(x, F.lit(0.0))) + (1.0 if mode == "reference" else 0.0))


def generalized_mean(x, f: Unary, inverse: Unary) -> Column:
    return inverse(F.avg(f(clean(x))))


def weighted_mean(x, w) -> Column:
    x, w = clean(x), clean(w)
    return ratio(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))


def generalized_weighted_mean(x, w, f: Unary, inverse: Unary) -> Column:
    """Weights that sum to one are expected, as they are not scaled."""
    return inverse(F.sum(clean(w) * f(clean(x))))


def raw_moment(x, k: int) -> Column:
    return F.avg(F.pow(clean(x), F.lit(float(k))))


def pop_variance(x) -> Column:
    return F.var_pop(clean(x))


def smp_variance(x) -> Column:
    return F.var_samp(clean(x))


def pop_cv(x) -> Column:
    return ratio(F.stddev_pop(clean(x)), F.avg(clean(x)))


def smp_cv(x) -> Column:
    return ratio(F.stddev_samp(clean(x)), F.avg(clean(x)))


def third_central_moment(x) -> Column:
    x = clean(x)
    return F.skewness(x) * F.pow(F.stddev_pop(x), F.lit(3.0))


def skewness(x) -> Column:
    return F.skewness(clean(x))


def fourth_central_moment(x) -> Column:
    x = clean(x)
    return (F.kurtosis(x) + 3) * F.pow(F.var_pop(x), F.lit(2.0))


def kurtosis(x) -> Column:
    """Not less three."""
    return F.kurtosis(clean(x)) + 3


def normalized_kurtosis(x) -> Column:
    return kurtosis(x) / 3


def minimum(x) -> Column:
    return F.min(clean(x))


def maximum(x) -> Column:
    return F.max(clean(x))


def value_range(x) -> Column:
    return F.max(clean(x)) - F.min(clean(x))


def weighted_raw_moment(x, w, k: int) -> Column:
    x, w = clean(x), clean(w)
    return ratio(F.sum(w * F.pow(x, F.lit(float(k)))), F.sum(F.when(x.isNotNull(), w)))


def weighted_central_moment(x, w, k: int) -> Column:
    """From raw moments, second to fourth."""
    m = [F.lit(1.0), *(weighted_raw_moment(x, w, j) for j in range(1, k + 1))]
    if k == 2:
        return m[2] - m[1] * m[1]
    if k == 3:
        return m[3] - 3 * m[1] * m[2] + 2 * F.pow(m[1], F.lit(3.0))
    return m[4] - 4 * m[1] * m[3] + 6 * m[1] * m[1] * m[2] - 3 * F.pow(m[1], F.lit(4.0))


def weighted_variance(x, w) -> Column:
    return weighted_central_moment(x, w, 2)


def weighted_skewness(x, w) -> Column:
    return ratio(weighted_central_moment(x, w, 3), F.pow(weighted_variance(x, w), F.lit(1.5)))


def weighted_kurtosis(x, w) -> Column:
    return ratio(weighted_central_moment(x, w, 4), F.pow(weighted_variance(x, w), F.lit(2.0)))


def weighted_normalized_kurtosis(x, w) -> Column:
    return weighted_kurtosis(x, w) / 3


def mgf(x, t: float) -> Column:
    return F.avg(F.exp(num(t) * clean(x)))


def multivariate_mgf(xs: list[str], ts: list[float]) -> Column:
    return F.avg(F.exp(sum((t * clean(x) for x, t in zip(xs, ts, strict=True)), F.lit(0.0))))


def characteristic(x, t: float) -> Column:
    """Struct of the real and imaginary part."""
    z = num(t) * clean(x)
    return F.struct(F.avg(F.cos(z)).alias("re"), F.avg(F.sin(z)).alias("im"))


def multivariate_characteristic(xs: list[str], ts: list[float]) -> Column:
    z = sum((t * clean(x) for x, t in zip(xs, ts, strict=True)), F.lit(0.0))
    return F.struct(F.avg(F.cos(z)).alias("re"), F.avg(F.sin(z)).alias("im"))


def profile(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """The usual statistics of a column in one pass."""
    out = [
        F.count(clean(x)).alias("n"),
        mean(x).alias("mean"),
        geometric_mean(x).alias("geometric_mean"),
        harmonic_mean(x).alias("harmonic_mean"),
        pop_variance(x).alias("var_pop"),
        smp_variance(x).alias("var_smp"),
        pop_cv(x).alias("cv_pop"),
        smp_cv(x).alias("cv_smp"),
        skewness(x).alias("skewness"),
        kurtosis(x).alias("kurtosis"),
        minimum(x).alias("min"),
        maximum(x).alias("max"),
        value_range(x).alias("range"),
    ]
    return df.groupBy(*(by or [])).agg(*out)


def entropy(df: DataFrame, p: str, mode: str = "standard", tol: float = 1e-9) -> DataFrame:
    """``entropy`` of a column of probabilities; null unless they are 0 or more and
    sum to one.  The reference leaves out the sign."""
    q = clean(p)
    term = F.when(q > 0, q * F.log(q)).otherwise(F.lit(0.0))
    ok = (F.min(q) >= 0) & (F.abs(F.sum(q) - 1) <= tol)
    return df.agg(F.when(ok, F.sum(term) * (1 if mode == "reference" else -1)).alias("entropy"))


def chisini_mean(df: DataFrame, x: str, f: Callable[[Column], Column], tol: float = 1e-10, most: int = 200) -> float | None:
    """The number that, in place of every value, leaves the aggregate ``f`` as it
    is.  ``f`` maps a column to an aggregate and is monotone.  Each round is one
    aggregation of the data in which every value is replaced by each of 17
    candidates; a sixteenth of the range is left."""
    q = clean(x)
    low, high, n, goal = df.agg(F.min(q), F.max(q), F.count(q), f(q)).first()
    if not n:
        return None
    rising = None
    for _ in range(most):
        if high - low <= tol:
            break
        grid = [low + (high - low) * i / 16 for i in range(17)]
        y = df.agg(*[f(F.when(q.isNotNull(), F.lit(float(v)))).alias(f"y{i}") for i, v in enumerate(grid)]).first()
        rising = y[-1] >= y[0] if rising is None else rising
        k = next((i for i in range(1, 17) if (y[i] >= goal) == rising), 16)
        if grid[k] - grid[k - 1] >= high - low:
            break  # doubles between low and high have run out
        low, high = grid[k - 1], grid[k]
    return (low + high) / 2


def frechet_variance(df: DataFrame, distance: Column) -> Column:
    """Mean squared distance, as an aggregate."""
    return F.avg(distance * distance)


def frechet_mean(df: DataFrame, distance: Callable[[list[float]], Column], start: list[float], step: float = 1.0, most: int = 100) -> list[float]:
    """Minimises the mean squared distance by coordinate search; each round is one
    job that tries a step up and down in every coordinate."""
    at = [float(v) for v in start]
    while step > 1e-6 and most:
        tries = [at] + [[v + d * (i == j) for j, v in enumerate(at)] for i in range(len(at)) for d in (step, -step)]
        row = df.agg(*[F.avg(distance(t) * distance(t)).alias(f"v{i}") for i, t in enumerate(tries)]).first()
        best = min(range(len(tries)), key=lambda i: (row[i], i))
        at, step, most = tries[best], step / 2 if best == 0 else step, most - 1
    return at


def grouped_udf(statistic: Callable[[pd.Series], float]):
    """A user statistic of a group's values as an aggregate (Arrow)."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> float:
        return float(statistic(x))

    return run


def empirical_likelihood(df: DataFrame, x: str, mean: float, steps: int = 60) -> tuple[float, float]:
    """Multiplier and log ratio of the empirical likelihood of a mean: weights are
    ``1 / (n (1 + multiplier (x - mean)))``.  Newton steps, one job each, kept
    where all weights are positive; the mean must lie inside the data."""
    z = clean(x) - mean
    low, high = df.agg(F.min(z), F.max(z)).first()
    if low is None or not low < 0 < high:
        raise ValueError("the mean must lie between the least and the greatest value")
    at, down, up = 0.0, -1 / high, -1 / low
    for _ in range(steps):
        w = 1 / (1 + at * z)
        g, h = df.agg(F.sum(z * w), F.sum(z * z * w * w)).first()
        # the sum falls as the multiplier grows, so the root is bracketed
        down, up = (at, up) if g > 0 else (down, at)
        step = g / h
        following = at + step
        if not down < following < up:
            following = (down + up) / 2
        done, at = abs(following - at) <= 1e-12 * max(1.0, abs(at)), following
        if done:
            break
    return at, -float(df.agg(F.sum(F.log1p(at * z))).first()[0])


def empirical_weights(df: DataFrame, x: str, mean: float, multiplier: float, name: str = "weight") -> DataFrame:
    """``df`` with each row's weight times the number of rows; small for outliers."""
    return df.withColumn(name, 1 / (1 + multiplier * (clean(x) - mean)))
