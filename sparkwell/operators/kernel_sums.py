"""Sums under a kernel of one coordinate, without pairs of rows and queries.

Rows are added up in cells much narrower than the kernel, as moments about the cells'
centres.  A query takes whole cells by their moments:

* Gauss' kernel of ``u - v`` (a row and a query, from a centre, in widths) is
  ``exp(-v^2 / 2) exp(-u^2 / 2) exp(uv)``; ``uv`` is at most 1.3 where the kernel is not
  zero as a double, so that ``TERMS`` terms of the last factor's series leave less than
  rounding does.
* A kernel that is a polynomial up to its width is one of ``u`` too.  Cells that its ends
  cut are left to the pairs.

Both are as exact as the sum over pairs.  The work is the rows, and the queries times the
cells in reach, whatever the number of rows in a cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

#: Terms of the series, and cells in the width, of Gauss' kernel.
TERMS, FINE = 20, 16
#: Widths beyond which Gauss' kernel is zero as a double.
REACH = 39
#: Cells and queries that a task holds against each other at once.
GROUP, ASKED = 256, 1024
#: Numbers further from zero, in widths, are left to the pairs.
MOST = 1e9
#: Cells in the width of a polynomial kernel.
STEPS = 128
#: Coefficients of 1, z^2, z^4 ... of kernels that are polynomials up to their width.
POLYNOMIALS: dict[Callable[[Column], Column], tuple[float, ...]] = {
    kernels.uniform: (0.5,),
    kernels.epanechnikov: (0.75, -0.75),
    kernels.quartic: (15 / 16, -15 / 8, 15 / 16),
    kernels.triweight: (35 / 32, -105 / 32, 105 / 32, -35 / 32),
}


def placed(x: Column, width: float) -> Column:
    """Whether ``x`` has a cell; false for nulls and NaN."""
    return F.coalesce(F.abs(x) <= MOST * width, F.lit(False))


def finite(y: Column) -> Column:
    """A null adds nothing and counts as finite."""
    return F.coalesce(F.abs(y) < float("inf"), F.lit(True))


def gauss_sums(queries: DataFrame, rows: DataFrame, width: float, n_queries: int) -> DataFrame:
    """``query`` and the sums ``s0``, ``s1``, ``s2`` of ``K (x - q)^i`` and ``t0``, ``t1``
    of ``K y (x - q)^i`` over all rows (``x``, ``y``), under ``kernels.gaussian``, for ``queries`` (``query``, ``q``); parts of a sum are rows of their own.  Queries with
    no row in reach have none."""
    spark = rows.sparkSession
    step = width / FINE
    cell = F.floor(F.col("x") / step)
    u = (F.col("x") - (F.col("_cell") + 0.5) * step) / width
    part = rows.withColumn("_cell", cell).select("_cell", u.alias("u"), F.exp(-0.5 * u * u).alias("e"), F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"))
    power = [F.col("e") * F.pow(F.col("u"), F.lit(float(k))) for k in range(TERMS + 2)]
    moments = [F.sum(p).alias(f"a{k}") for k, p in enumerate(power)] + [F.sum(p * F.col("y")).alias(f"b{k}") for k, p in enumerate(power[:-1])]
    cells = part.groupBy("_cell").agg(*moments)
    numbers = F.array(*[f"a{k}" for k in range(TERMS + 2)], *[f"b{k}" for k in range(TERMS + 1)])
    groups = cells.groupBy(F.floor(F.col("_cell") / GROUP).alias("_group")).agg(F.collect_list(F.struct("_cell", numbers.alias("m"))).alias("cells"))
    at = lambda c: F.floor(c / (step * GROUP))
    dealt = queries.withColumn("_group", F.explode(F.sequence(at(F.col("q") - REACH * width) - 1, at(F.col("q") + REACH * width) + 1)))
    chunk = F.pmod(F.xxhash64("query"), F.lit(-(-n_queries // ASKED)))
    chunks = dealt.groupBy("_group", chunk.alias("_chunk")).agg(F.collect_list("query").alias("query"), F.collect_list("q").alias("q"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2000, n_queries // ASKED))
    kind = dict(queries.dtypes)["query"]
    both = groups.join(chunks, "_group").select("cells._cell", F.flatten("cells.m").alias("m"), "query", "q").repartition(parts)
    return both.mapInArrow(_gauss(width), f"query {kind}, s0 double, s1 double, s2 double, t0 double, t1 double")


def _gauss(width: float):
    def series(a: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.repeat(a[None, :, TERMS - 1], len(v), 0)
        for k in range(TERMS - 1, 0, -1):
            out *= v
            out /= k
            out += a[:, k - 1]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell, m, names, q = (batch.column(j).slice(i, 1).flatten() for j in range(4))
                centre = (cell.to_numpy() + 0.5) * (width / FINE)
                m = m.to_numpy().reshape(len(centre), -1)
                a, b = m[:, : TERMS + 2], m[:, TERMS + 2 :]
                v = (q.to_numpy()[:, None] - centre) / width
                g = np.exp(-0.5 * v * v) / math.sqrt(2 * math.pi)
                a0, a1, a2 = (series(a[:, k:], v) for k in range(3))
                b0, b1 = (series(b[:, k:], v) for k in range(2))
                # (u - v)^i of a row by the sums of u^i
                found = [a0, (a1 - v * a0) * width, (a2 - 2 * v * a1 + v * v * a0) * width**2, b0, (b1 - v * b0) * width]
                yield pa.record_batch([names, *(pa.array((g * f).sum(1)) for f in found)], ["query", "s0", "s1", "s2", "t0", "t1"])

    return run


def polynomial_sums(queries: DataFrame, rows: DataFrame, width: float, kernel: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Sums ``s`` of ``K n`` and ``t`` of ``K y`` of ``rows`` (``x``, ``n``, ``y``) over the
    cells that lie within the width of a query (``query``, ``q``), a cell a row; and the
    pairs (``x``, ``n``, ``y``, ``query``, ``q``) of the cells that its ends cut."""
    reach, inner = width * (1 + 1e-9), width * (1 - 1e-9)
    step = reach / STEPS
    at = lambda c: F.floor(c / step)
    cell = F.col("_cell")
    dealt = queries.withColumn("_cell", F.explode(F.sequence(at(F.col("q") - reach), at(F.col("q") + reach))))
    inside = (cell * step >= F.col("q") - inner) & ((cell + 1) * step <= F.col("q") + inner)
    placed_rows = rows.withColumn("_cell", at(F.col("x")))
    cut = placed_rows.join(dealt.where(~inside), "_cell").where(F.abs(F.col("x") - F.col("q")) <= reach).drop("_cell")
    terms = POLYNOMIALS[kernel]
    u = (F.col("x") - (cell + 0.5) * step) / width
    power = [F.lit(1.0) if k == 0 else F.pow(u, F.lit(float(k))) for k in range(2 * len(terms) - 1)]
    moments = [F.sum(F.col(c) * p).alias(f"{c}{k}") for c in ("n", "y") for k, p in enumerate(power)]
    cells = placed_rows.groupBy("_cell").agg(*moments)
    v = (F.col("q") - (cell + 0.5) * step) / width

    def total(c: str) -> Column:
        out = F.lit(0.0)
        for j, a in enumerate(terms):
            for i in range(2 * j + 1):
                out = out + F.col(f"{c}{i}") * F.pow(-v, F.lit(float(2 * j - i))) * (a * math.comb(2 * j, i))
        return out

    whole = cells.join(dealt.where(inside), "_cell").select("query", total("n").alias("s"), total("y").alias("t"))
    return whole, cut
