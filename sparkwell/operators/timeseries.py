"""Series in an explicit order: differences, lags, autoregression.

The order column is named, never implicit, and ``by`` gives one series a group.
Lags are read through row numbers: rows are numbered by ranges of the order, and
each is joined with its neighbours' numbers, so one long series is spread over
all tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clean
from ..plans.ranks import global_rank
from ..sources.store import staged
from .linear import gram

#: Row numbers in a block; windows look one block back or ahead.
BLOCK = 4096


def shifted(df: DataFrame, x: str, order: str, offsets: list[int]) -> DataFrame:
    """``df`` with its row number ``_rn`` and ``_s{i}``: ``x`` of the row
    ``offsets[i]`` rows on (back if negative; null beyond the ends).

    Rows form blocks of ``BLOCK`` numbers; those near a block's ends go to the
    neighbouring block too, so a window never spans more than one block."""
    reach = max([abs(o) for o in offsets] + [1])
    if reach > BLOCK // 2:
        raise ValueError(f"offsets must lie within {BLOCK // 2}")
    rows = global_rank(df, [order], "_rn")
    home = F.floor(F.col("_rn") / BLOCK)
    homes = F.array_distinct(F.array(home, F.floor((F.col("_rn") - reach) / BLOCK), F.floor((F.col("_rn") + reach) / BLOCK)))
    spread = rows.withColumn("_home", home).withColumn("_block", F.explode(homes))
    w = Window.partitionBy("_block").orderBy("_rn")
    out = spread.select("*", *[F.lead(clean(x), o).over(w).alias(f"_s{i}") if o >= 0 else F.lag(clean(x), -o).over(w).alias(f"_s{i}") for i, o in enumerate(offsets)])
    return out.where(F.col("_block") == F.col("_home")).drop("_block", "_home")


def difference(df: DataFrame, x: str, order: str, d: int = 1, mode: str = "standard") -> DataFrame:
    """``order``, ``diff``: the ``d``-th forward difference; the reference's sign is
    (-1)^d times it.  The last ``d`` rows have none."""
    rows = shifted(df.select(order, x), x, order, list(range(d + 1)))
    out = F.lit(0.0)
    for j in range(d + 1):
        sign = (-1) ** (j if mode == "reference" else d - j)
        out = out + sign * math.comb(d, j) * F.col(f"_s{j}")
    return rows.select(order, out.alias("diff")).where("diff IS NOT NULL")


def lag_matrix(df: DataFrame, x: str, order: str, p: int, centre: float = 0.0) -> DataFrame:
    """``order``, ``target`` and ``lag1`` to ``lagp`` (1 is the nearest), centred;
    rows without all lags are left out."""
    rows = shifted(df.select(order, x), x, order, [0] + [-k for k in range(1, p + 1)])
    return rows.select(
        order, (F.col("_s0") - centre).alias("target"), *[(F.col(f"_s{k}") - centre).alias(f"lag{k}") for k in range(1, p + 1)]
    ).dropna(subset=["target", *[f"lag{k}" for k in range(1, p + 1)]])


@dataclass(frozen=True)
class Series:
    mean: float
    ar: np.ndarray
    ma: np.ndarray


def fit_ar(df: DataFrame, x: str, order: str, p: int) -> Series:
    """Centred least squares on the lags, without a constant."""
    mu = df.agg(F.avg(clean(x))).first()[0]
    g = gram(lag_matrix(df, x, order, p, mu), [*[f"lag{k}" for k in range(1, p + 1)], "target"])
    return Series(mu, np.linalg.solve(g[:p, :p], g[:p, p]), np.zeros(0))


def ar_residuals(df: DataFrame, x: str, order: str, fit: Series, name: str = "residual") -> DataFrame:
    p = len(fit.ar)
    rows = lag_matrix(df, x, order, p, fit.mean)
    guess = sum((float(c) * F.col(f"lag{k + 1}") for k, c in enumerate(fit.ar)), F.lit(0.0))
    return rows.select(order, (F.col("target") - guess).alias(name))


def fit_ma(df: DataFrame, x: str, order: str, q: int, passes: int = 20, tol: float = 1e-8) -> Series:
    """Residuals stand for the shocks: each pass regresses the centred series on
    the lagged residuals of the pass before (missing ones are zero)."""
    mu = df.agg(F.avg(clean(x))).first()[0]
    rows = staged(df.select(order, (clean(x) - mu).alias("target"), (clean(x) - mu).alias("e")), "shocks")
    theta = np.zeros(q)
    for _ in range(passes):
        lagged = shifted(rows, "e", order, [-k for k in range(1, q + 1)]).fillna(0.0, [f"_s{k}" for k in range(q)])
        lagged = staged(lagged.drop("_rn"), "shocks")
        g = gram(lagged, [*[f"_s{k}" for k in range(q)], "target"])
        new = np.linalg.lstsq(g[:q, :q], g[:q, q], rcond=None)[0]
        moved, theta = np.abs(new - theta).max(), new
        guess = sum((float(c) * F.col(f"_s{k}") for k, c in enumerate(theta)), F.lit(0.0))
        rows = staged(lagged.select(order, "target", (F.col("target") - guess).alias("e")), "shocks")
        if moved < tol:
            break
    return Series(mu, np.zeros(0), theta)


def fit_arma(df: DataFrame, x: str, order: str, p: int, q: int) -> Series:
    """The autoregression first, the moving average on its residuals."""
    ar = fit_ar(df, x, order, p)
    ma = fit_ma(ar_residuals(df, x, order, ar), "residual", order, q)
    return Series(ar.mean, ar.ar, ma.ma)
