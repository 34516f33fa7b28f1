"""Linear and generalised linear models.

Every step of a fit is one aggregation over the data; the driver solves a system
as large as the number of predictors, and the new coefficients enter the next
plan as numbers.  No constant is added: give ``lit(1)`` as a predictor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clean, col
from ..sources.store import staged
from .linear import gram

Cols = list[Column | str]


@dataclass(frozen=True)
class Fit:
    coefficients: np.ndarray
    steps: int = 1

    def predictor(self, x: Cols) -> Column:
        return linear(x, self.coefficients)


def linear(x: Cols, beta: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, b in zip(x, beta, strict=True):
        out = out + float(b) * clean(c)
    return out


def ols(df: DataFrame, y: Column | str, x: Cols, weight: Column | str | None = None) -> Fit:
    """(Weighted) least squares from one Gram matrix."""
    g = gram(df, [*x, y], weight)
    return Fit(np.linalg.solve(g[:-1, :-1], g[:-1, -1]))


def residuals(df: DataFrame, y: Column | str, x: Cols, fit: Fit, name: str = "residual") -> DataFrame:
    return df.withColumn(name, clean(y) - fit.predictor(x))


def coefficient_covariance(df: DataFrame, y: Column | str, x: Cols) -> np.ndarray:
    """Residual variance (n - p degrees) times the inverse Gram matrix, in one job."""
    g = gram(df, [*x, y, F.lit(1.0)])
    p, n = len(x), g[-1, -1]
    a, b = g[:p, :p], g[:p, p]
    inverse = np.linalg.inv(a)
    rss = g[p, p] - b @ inverse @ b
    return inverse * rss / (n - p)


def least_absolute(df: DataFrame, y: Column | str, x: Cols, weight: Column | str | None = None, steps: int = 100, floor: float = 1e-6) -> Fit:
    """Least absolute residuals by weights ``1 / |r|``."""
    fit, w = ols(df, y, x, weight), col(weight) if weight is not None else F.lit(1.0)
    for step in range(1, steps + 1):
        r = F.abs(clean(y) - fit.predictor(x))
        new = ols(df, y, x, w / F.greatest(r, F.lit(floor)))
        moved = np.abs(new.coefficients - fit.coefficients).max()
        fit = Fit(new.coefficients, step)
        if moved < 1e-9:
            break
    return fit


def _newton(df: DataFrame, y: Column | str, x: Cols, start: np.ndarray, mean, curvature, steps: int, tol: float) -> Fit:
    """Steps ``(X' W X)^-1 X' (y - mu)``."""
    beta = start
    for step in range(1, steps + 1):
        mu = mean(linear(x, beta))
        rows = df.select(*[clean(c).alias(f"x{i}") for i, c in enumerate(x)], (clean(y) - mu).alias("r"), curvature(mu).alias("w")).dropna()
        p = len(x)
        sums = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(p) for j in range(i, p)]
        row = rows.agg(*sums, *[F.sum(F.col("r") * F.col(f"x{i}")) for i in range(p)]).first()
        h = np.zeros((p, p))
        h[np.triu_indices(p)] = row[: p * (p + 1) // 2]
        h = h + np.triu(h, 1).T
        move = np.linalg.solve(h, np.array(row[p * (p + 1) // 2 :]))
        beta = beta + move
        if np.abs(move).max() < tol:
            break
    return Fit(beta, step)


def logit(df: DataFrame, y: Column | str, x: Cols, steps: int = 25, tol: float = 1e-10) -> Fit:
    """Starts from least squares on ``4 y - 2``."""
    start = ols(df, 4 * clean(y) - 2, x).coefficients
    return _newton(df, y, x, start, lambda e: 1 / (1 + F.exp(-e)), lambda m: m * (1 - m), steps, tol)


# Curvature of the log-link fits, by the mean.  All have the score X' (y - mu).
_CURVATURES = {
    "poisson": lambda m: m,
    "gamma": lambda m: m * m,
    "negative_binomial": lambda m: m + m * m,
    "inverse_gaussian": lambda m: m * m * m,
}


def log_link(df: DataFrame, y: Column | str, x: Cols, family: str = "poisson", steps: int = 100, tol: float = 1e-10) -> Fit:
    """Starts from least squares on ``ln y`` (``y - 1`` where y is at most 1)."""
    z = F.when(clean(y) > 1, F.log(clean(y))).otherwise(clean(y) - 1)
    return _newton(df, y, x, ols(df, z, x).coefficients, F.exp, _CURVATURES[family], steps, tol)


def forward_stagewise(df: DataFrame, y: Column | str, x: Cols, bound: float | None = None, steps: int = 500, rate: float = 0.05) -> Fit:
    """Adaptive forward stagewise regression.

    Each step adds the column with the largest gradient to the active set and
    goes a part of the way to its least squares fit.  Stops when the sum of
    absolute coefficients reaches ``bound``, or without one when the Bayesian
    information criterion no longer falls.  One job, then the driver alone.
    """
    g = gram(df, [*x, y, F.lit(1.0)])
    p, n = len(x), g[-1, -1]
    a, b, yy = g[:p, :p], g[:p, p], g[p, p]
    beta, active = np.zeros(p), []
    rss = lambda v: yy - 2 * v @ b + v @ a @ v
    criterion = n * np.log(max(yy, 1e-300) / n)
    for step in range(1, steps + 1):
        gradient = b - a @ beta
        k = int(np.argmax(np.abs(gradient)))
        if k not in active:
            active.append(k)
        target = np.zeros(p)
        target[active] = np.linalg.lstsq(a[np.ix_(active, active)], b[active], rcond=None)[0]
        new = beta + rate * (target - beta)
        if bound is not None:
            if np.abs(new).sum() >= bound:
                break
        else:
            now = n * np.log(max(rss(new), 1e-300) / n) + len(active) * np.log(n)
            if now >= criterion and step > 1:
                break
            criterion = now
        beta = new
    return Fit(beta, step)


def capture_recapture(
    df: DataFrame, lists: list[tuple[str, Cols]], steps: int = 200, rate: float = 0.01, decay: float = 0.01
) -> list[np.ndarray]:
    """Logits of being on each of two or more lists, fitted to those on at least
    one, by the Lion method on the conditional likelihood.

    ``lists``: for each the 0/1 column and its predictors.  Rows that agree in all of
    them are counted once, as a table; each step is one aggregation over it that gives
    the whole gradient.
    """
    betas = [np.zeros(len(x)) for _, x in lists]
    moments = [np.zeros(len(x)) for _, x in lists]
    seen = sum((clean(y) for y, _ in lists), F.lit(0.0)) > 0
    names = [(f"_y{i}", [f"_x{i}_{j}" for j in range(len(x))]) for i, (_, x) in enumerate(lists)]
    columns = [c.alias(n) for (y, x), (yn, xn) in zip(lists, names, strict=True) for c, n in zip([clean(y), *map(clean, x)], [yn, *xn], strict=True)]
    rows = staged(df.where(seen).select(*columns).groupBy(*[n for yn, xn in names for n in (yn, *xn)]).agg(F.count("*").cast("double").alias("_n")), "seen")
    lists = [(yn, [F.col(c) for c in xn]) for yn, xn in names]
    for step in range(steps):
        probs = [1 / (1 + F.exp(-linear(x, b))) for (_, x), b in zip(lists, betas, strict=True)]
        missed = F.lit(1.0)
        for q in probs:
            missed = missed * (1 - q)
        sums = []
        for (y, x), q in zip(lists, probs, strict=True):
            # of the log-likelihood less that of being seen at all
            pull = clean(y) - q - q * missed / (1 - missed)
            sums += [F.sum(F.col("_n") * pull * c) / F.sum(F.when((pull * c).isNotNull(), F.col("_n"))) for c in x]
        row, at = rows.agg(*sums).first(), 0
        for i, (_, x) in enumerate(lists):
            g = -np.array(row[at : at + len(x)], float)
            at += len(x)
            move = np.sign(0.9 * moments[i] + 0.1 * g)
            betas[i] = betas[i] - rate * (1 - step / steps) * (move + decay * betas[i])
            moments[i] = 0.99 * moments[i] + 0.01 * g
    return betas


def population_size(df: DataFrame, lists: list[tuple[str, Cols]], betas: list[np.ndarray]) -> DataFrame:
    """``n_hat``: those seen, each over their chance of being seen."""
    missed = F.lit(1.0)
    for (_, x), b in zip(lists, betas, strict=True):
        missed = missed * (1 - 1 / (1 + F.exp(-linear(x, b))))
    seen = sum((clean(y) for y, _ in lists), F.lit(0.0)) > 0
    return df.where(seen).agg(F.sum(1 / (1 - missed)).alias("n_hat"))
