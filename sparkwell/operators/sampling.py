"""Sampling designs and resampling.

Every draw is a function of the row's key and the seed, so a sample does not
depend on partitioning and a task that runs again draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bound, clean, uniform
from ..plans.ranks import global_rank, running_sum


def simple_with_replacement(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``key``, ``count``: how often each unit is drawn in ``n`` draws; units never
    drawn are left out."""
    size = df.count()
    draws = df.sparkSession.range(n).select(F.floor(uniform(seed, "id") * size).cast("long").alias("_t"))
    hits = draws.groupBy("_t").agg(F.count("*").alias("count"))
    numbered = global_rank(df.select(key), [key], "_rn").select(key, (F.col("_rn") - 1).alias("_t"))
    return numbered.join(hits, "_t").select(key, "count")


def simple_without_replacement(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows: those with the smallest numbers."""
    return df.withColumn("_u", uniform(seed, key)).orderBy("_u", key).limit(n).drop("_u")


def poisson(df: DataFrame, key: str, pik: str, seed: int) -> DataFrame:
    return df.where(uniform(seed, key) < clean(pik))


def conditional_poisson(df: DataFrame, key: str, pik: str, n: int, seed: int, tries: int = 64, rounds: int = 32) -> DataFrame:
    """A Poisson sample given that it has ``n`` rows, by rejection: the first of
    the samples drawn in turn that has that size.  The sizes of ``tries`` samples
    are counted in one job; if none fits, the next ``tries`` are drawn.  The
    shares should add up to about ``n``; ValueError if no sample in ``rounds``
    jobs fits."""
    for first in range(0, tries * rounds, tries):
        draws = [uniform(seed * 4099 + t, key) < clean(pik) for t in range(first, first + tries)]
        sizes = list(df.agg(*[F.coalesce(F.sum(d.cast("int")), F.lit(0)).alias(f"s{t}") for t, d in enumerate(draws)]).first())
        if n in sizes:
            return df.where(draws[sizes.index(n)])
    raise ValueError(f"no sample of {n} rows among {tries * rounds}")


def pareto(df: DataFrame, key: str, pik: str, n: int, seed: int) -> DataFrame:
    """Order sampling: the ``n`` smallest ``u (1 - p) / (p (1 - u))``."""
    u, p = uniform(seed, key), clean(pik)
    q = u * (1 - p) / F.nullif(p * (1 - u), F.lit(0.0))
    return df.withColumn("_q", q).where("_q IS NOT NULL").orderBy("_q", key).limit(n).drop("_q")


def systematic(df: DataFrame, key: str, pik: str, seed: int = 1, start: float | None = None) -> DataFrame:
    """Rows at which the running sum of the shares passes ``start`` plus a whole
    number, in the order of ``key``."""
    u = start if start is not None else df.sparkSession.range(1).select(uniform(seed, F.lit(0))).first()[0]
    rows = running_sum(df.withColumn("_v", clean(pik)), [], [key], "_v", "_hi", "_total")
    return rows.where(F.floor(F.col("_hi") - u) > F.floor(F.col("_hi") - F.col("_v") - u)).drop("_v", "_hi", "_total")


def multinomial(df: DataFrame, key: str, pik: str, n: int, seed: int) -> DataFrame:
    """``key``, ``count`` of ``n`` draws with shares proportional to ``pik``: each
    draw falls into one step of the running sum."""
    rows = running_sum(df.select(key, clean(pik).alias("_v")).where("_v > 0"), [], [key], "_v", "_hi", "_total")
    total = rows.agg(F.max("_total")).first()[0]
    if not total:
        return rows.select(key, F.lit(0).cast("long").alias("count")).limit(0)
    draws = df.sparkSession.range(n).select((uniform(seed, "id") * total).alias("_t"))
    # steps and draws meet in cells of equal width, so each looks at few others
    cells = 1024
    width = total / cells
    steps = rows.select(
        key, (F.col("_hi") - F.col("_v")).alias("_a"), "_hi", F.explode(F.sequence(F.floor((F.col("_hi") - F.col("_v")) / width), F.floor(F.col("_hi") / width))).alias("_cell")
    )
    hit = draws.withColumn("_cell", F.floor(F.col("_t") / width)).join(steps, "_cell").where("_t >= _a AND _t < _hi")
    return hit.groupBy(key).agg(F.count("*").alias("count"))


Statistic = Callable[[Column], Column]


def _poisson_one(u: Column) -> Column:
    """A Poisson number with mean one from a uniform one: how many steps of the
    distribution function lie at or below it."""
    step, below, steps = math.exp(-1), 0.0, []
    for k in range(1, 18):
        below += step
        step /= k
        steps.append(below)
    # bound: the number is drawn once and not at each step
    return bound(u, lambda v: sum((F.when(v >= at, 1).otherwise(0) for at in steps), F.lit(0)))


def bootstrap(df: DataFrame, key: str, x: str, replicates: int, statistic: Statistic, seed: int) -> DataFrame:
    """``b``, ``value``: the statistic of resamples with replacement.  Each row's
    number of copies is drawn (Poisson with mean one), so a replicate needs no
    shuffle of rows; ``statistic`` maps a column to an aggregate."""
    rows = df.select(key, clean(x).alias("_x")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    # no copies are no rows; a filter on their number would draw it again
    drawn = rows.select("b", F.explode(F.array_repeat("_x", _poisson_one(uniform(seed, key, "b")))).alias("_x"))
    return drawn.groupBy("b").agg(statistic(F.col("_x")).alias("value"))


def subsample(df: DataFrame, key: str, x: str, size: int, replicates: int, statistic: Statistic, seed: int) -> DataFrame:
    """The same for subsamples without replacement, of ``size`` rows in the mean."""
    share = size / max(1, df.count())
    rows = df.select(key, clean(x).alias("_x")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return rows.where(uniform(seed, key, "b") < share).groupBy("b").agg(statistic(F.col("_x")).alias("value"))


def jackknife_mean(df: DataFrame, x: str) -> DataFrame:
    """``mean``, ``variance`` of the leave-one-out means (over n - 1), from sums."""
    q = clean(x)
    n, s = F.count(q).cast("double"), F.sum(q)
    return df.agg(
        (s / F.nullif(n, F.lit(0.0))).alias("mean"),
        (F.var_pop(q) * n / F.nullif(F.pow(n - 1, F.lit(3.0)), F.lit(0.0))).alias("variance"),
    )


def pseudo_values(df: DataFrame, key: str, x: str, statistic: Callable[[Column, Column], Column], sums: list[Column]) -> DataFrame:
    """``key``, ``pseudo``: n t - (n - 1) t without the row.

    ``sums``: aggregates that add up over rows, as functions of column ``x``
    given as ``sum`` arguments (for the variance: x and x^2).  ``statistic`` maps
    their array and n to the statistic; leaving a row out is subtracting it.
    """
    rows = df.select(key, clean(x).alias(x)).where(F.col(x).isNotNull())
    total = rows.agg(F.count("*").cast("double").alias("_n"), F.array(*[F.sum(s) for s in sums]).alias("_s"))
    each = rows.crossJoin(F.broadcast(total))  # one row
    own = F.array(*sums)
    less = F.zip_with("_s", own, lambda a, b: a - b)
    n = F.col("_n")
    return each.select(key, (n * statistic(F.col("_s"), n) - (n - 1) * statistic(less, n - 1)).alias("pseudo"))


def jackknife(pseudo: DataFrame) -> DataFrame:
    """``estimate``, ``variance`` of pseudo-values."""
    return pseudo.agg(F.avg("pseudo").alias("estimate"), (F.var_samp("pseudo") / F.count("pseudo")).alias("variance"))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_u", uniform(seed, key)).orderBy("_u", key).drop("_u")
