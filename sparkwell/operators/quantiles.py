"""Quantiles by rank, weighted quantiles, and empirical distribution functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clean
from ..plans.ranks import dominated_counts, global_rank, lower_sums, running_sum
from ..sources.store import staged


def _ranked(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Values that occur, with the first and last rank of each.

    Equal values are counted before they are sorted, so one row a value moves."""
    counts = df.select(*by, clean(x).alias("_x")).where("_x IS NOT NULL").groupBy(*by, "_x").agg(F.count("*").alias("_c"))
    return running_sum(counts, by, ["_x"], "_c")


def quantiles(df: DataFrame, x: str, probs: list[float], by: list[str] | None = None, mode: str = "standard") -> DataFrame:
    """``by``, ``prob``, ``quantile``: linear interpolation of the empirical
    distribution function (type 4).  Below the first step the least value; the
    reference goes on to interpolate there."""
    by = by or []
    ranks = _ranked(df, x, by)
    p = ranks.select("*", F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("prob"))
    pos = F.col("_n") * F.col("prob")
    low = F.greatest(F.floor(pos + F.lit(1e-9)), F.lit(1))
    part = pos - low if mode == "reference" else F.greatest(pos - low, F.lit(0.0))
    if mode == "reference":
        part = F.when(pos < 1, pos).otherwise(part)
    high = F.least(low + 1, F.col("_n"))
    first = F.min(F.when(F.col("_hi") >= low, F.col("_x")))
    second = F.min(F.when(F.col("_hi") >= high, F.col("_x")))
    return p.groupBy(*by, "prob").agg((first + F.max(part) * (second - first)).alias("quantile"))


def fivenum(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    q = quantiles(df, x, [0.0, 0.25, 0.5, 0.75, 1.0], by)
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    names = ["minimum", "lower", "middle", "upper", "maximum"]
    return q.groupBy(*by).agg(*[at(p).alias(n) for p, n in zip([0.0, 0.25, 0.5, 0.75, 1.0], names, strict=True)])


def iqr(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    return fivenum(df, x, by).select(*(by or []), (F.col("upper") - F.col("lower")).alias("iqr"))


def median(x) -> Column:
    return F.median(clean(x))


def weighted_quantile(df: DataFrame, x: str, w: str, prob: float, by: list[str] | None = None) -> DataFrame:
    """``by``, ``quantile``: the first value whose cumulative weight reaches the
    share ``prob``.  Weights of equal values are added before the sort."""
    by = by or []
    sums = df.select(*by, clean(x).alias("_x"), clean(w).alias("_w")).where("_x IS NOT NULL").groupBy(*by, "_x").agg(F.sum("_w").alias("_w"))
    run = running_sum(sums, by, ["_x"], "_w", "_c", "_t")
    return run.where(F.col("_c") >= F.lit(prob) * F.col("_t") - 1e-9 * F.abs("_t")).groupBy(*by).agg(F.min("_x").alias("quantile"))


def weighted_median(df: DataFrame, x: str, w: str, by: list[str] | None = None) -> DataFrame:
    """The minimiser of the weighted absolute deviations: the iterative, the sorted
    and the histogram form of the original come to this value."""
    return weighted_quantile(df, x, w, 0.5, by).withColumnRenamed("quantile", "weighted_median")


def weighted_iqr(df: DataFrame, x: str, w: str) -> DataFrame:
    a, b = (weighted_quantile(df, x, w, p).toDF(n) for p, n in ((0.25, "lower"), (0.75, "upper")))
    return a.crossJoin(b).select((F.col("upper") - F.col("lower")).alias("weighted_iqr"))  # one row each


def ecdf(df: DataFrame, x: str) -> DataFrame:
    """``value``, ``ecdf`` for each value that occurs: the share of values up to it."""
    r = _ranked(df, x, [])
    return r.select(F.col("_x").alias("value"), (F.col("_hi") / F.col("_n")).alias("ecdf"))


def ecdf_at(x: str, y: float, mode: str = "standard") -> Column:
    """Share of values up to ``y``; the reference gives the share above it."""
    q = clean(x)
    return F.avg((q > y if mode == "reference" else q <= y).cast("double"))


def box_share(columns: list[str], low: list[float], high: list[float], closed: str = "right") -> Column:
    """Share of rows in a box, ``closed`` at its ``right`` end, ``both`` or ``none``."""
    inside = F.lit(True)
    for c, a, b in zip(columns, low, high, strict=True):
        q = clean(c)
        inside = inside & (q >= a if closed == "both" else q > a) & (q < b if closed == "none" else q <= b)
    return F.avg(F.coalesce(inside, F.lit(False)).cast("double"))


def joint_ecdf_at(columns: list[str], point: list[float]) -> Column:
    """Share of rows that no coordinate of ``point`` is below."""
    below = F.lit(True)
    for c, v in zip(columns, point, strict=True):
        below = below & (clean(c) <= v)
    return F.avg(F.coalesce(below, F.lit(False)).cast("double"))


def dominated_share(df: DataFrame, key: str, x1: str, x2: str) -> DataFrame:
    """``key``, ``share``: for each row the share of rows at or below it in both
    columns.

    Equal points are counted first; running sums over the digits of the ranks of
    ``x1`` take the place of pairs (``plans.ranks.lower_sums``).
    """
    rows = df.select(F.col(key).alias("_k"), clean(x1).alias("_a"), clean(x2).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    cells = staged(rows.groupBy("_a", "_b").agg(F.count("*").alias("_c")), "points")
    n = cells.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    same = running_sum(cells, ["_a"], ["_b"], "_c", "_in", "_t").select("_a", "_b", "_in")
    lower = lower_sums(cells, "_a", "_b", "_c", strict=False).select("_a", "_b", "_upto")
    counts = same.join(lower, ["_a", "_b"], "left").select("_a", "_b", (F.col("_in") + F.coalesce("_upto", F.lit(0))).alias("_n"))
    return rows.join(counts, ["_a", "_b"]).select(F.col("_k").alias(key), (F.col("_n") / F.lit(float(n or 1))).alias("share"))


def dominated_share_of(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key``, ``share``: for each row the share of rows at or below it in all of
    ``columns``, of any number.  Rows with a null or NaN there are left out.  Equal
    points are counted first; nested blocks of ranks take the place of pairs
    (``plans.ranks.dominated_counts``)."""
    names = [f"_x{i}" for i in range(len(columns))]
    rows = df.select(F.col(key).alias("_k"), *[clean(c).alias(n) for c, n in zip(columns, names, strict=True)]).dropna(subset=names)
    cells = staged(rows.groupBy(*names).agg(F.count("*").alias("_c")), "points")
    n = cells.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    counts = dominated_counts(cells, names, "_c")
    return rows.join(counts, names).select(F.col("_k").alias(key), (F.col("_n") / F.lit(float(n or 1))).alias("share"))


def rank_share(df: DataFrame, key: str, columns: list[str], norm: str = "product") -> DataFrame:
    """``key``, ``share``: each column's ``(rank - 1/2) / n`` combined by a t-norm,
    ``product`` or ``minimum``.  Ties are ranked by ``key``."""
    out = df.select(key, *[clean(c).alias(c) for c in columns])
    n = df.count()
    parts = []
    for i, c in enumerate(columns):
        out = global_rank(out, [c, key], f"_r{i}")
        parts.append((F.col(f"_r{i}") - 0.5) / F.lit(float(n or 1)))
    share = F.least(*parts) if norm == "minimum" and len(parts) > 1 else parts[0]
    if norm == "product":
        for p in parts[1:]:
            share = share * p
    return out.select(key, share.alias("share"))
