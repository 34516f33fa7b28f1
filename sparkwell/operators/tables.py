"""Frequency tables, indicators, mutual information, histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clean
from ..sources.store import staged
from .blocks import joined


def n_categories(x) -> Column:
    return F.count_distinct(x)


def counts(df: DataFrame, *columns: str) -> DataFrame:
    """One- and more-way tables: ``columns``, ``count``; null is a category."""
    return df.groupBy(*columns).agg(F.count("*").alias("count"))


def one_hot(df: DataFrame, x: str, categories: list, prefix: str = "is_") -> DataFrame:
    """``df`` with a double 0/1 column for each category; nothing is shuffled."""
    return df.select("*", *[F.coalesce((F.col(x) == c).cast("double"), F.lit(0.0)).alias(f"{prefix}{i}") for i, c in enumerate(categories)])


def normalized_mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """``nmi`` on a grid of ``sqrt(n / 4)`` equal steps each way, over the smaller
    entropy; null for 64 rows or fewer, or if a column is constant.

    Two jobs over the data: ranges, then cell counts; all else is on cells."""
    rows = df.select(clean(x).alias("x"), clean(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    n, x0, x1, y0, y1 = rows.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if n <= 64 or x0 == x1 or y0 == y1:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("nmi"))
    nb = int((n / 4) ** 0.5)
    cell = lambda c, a, b: F.least(F.floor((F.col(c) - a) * (nb / (b - a))), F.lit(nb - 1))
    joint = rows.groupBy(cell("x", x0, x1).alias("i"), cell("y", y0, y1).alias("j")).agg((F.count("*") / n).alias("p"))

    def bits(t: DataFrame) -> DataFrame:
        return t.agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))

    hx = bits(joint.groupBy("i").agg(F.sum("p").alias("p"))).withColumnRenamed("h", "hx")
    hy = bits(joint.groupBy("j").agg(F.sum("p").alias("p"))).withColumnRenamed("h", "hy")
    hxy = bits(joint).withColumnRenamed("h", "hxy")
    one = hx.crossJoin(hy).crossJoin(hxy)  # one row each
    return one.select(((F.col("hx") + F.col("hy") - F.col("hxy")) / F.nullif(F.least("hx", "hy"), F.lit(0.0))).alias("nmi"))


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """``bin``, ``count``, ``density`` of equal bins between the extremes."""
    rows = df.select(clean(x).alias("x")).where("x IS NOT NULL")
    n, low, high = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n or low == high:
        return rows.select(F.lit(0).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("count"), F.lit(None).cast("double").alias("density"))
    width = (high - low) / bins
    at = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1))
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("count"), (F.count("*") / (n * width)).alias("density"))


#: Values of a piece of the sorted values, and bin counts that share the values that
#: may lie together.
PIECE, BLOCK = 1 << 16, 2048
#: Tasks for each of the session's partitions.
WAVES = 16
#: Counts whose c log c is looked up.
LOOKED_UP = 1 << 20
#: By so much a gap must exceed a bin's width for its ends to lie in different bins
#: however they are rounded.
APART = 1 + 1e-6


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted values and their counts, some at a time as arrays."""
    for batch in joined(batches, PIECE):
        offsets = pa.array([0, batch.num_rows], pa.int32())
        yield pa.record_batch([pa.ListArray.from_arrays(offsets, batch.column(k)) for k in (0, 1)], ["z", "c"])


def _c_log_c(c: np.ndarray) -> np.ndarray:
    return c * np.log(np.maximum(c, 1))


def _block_starts(most: int) -> list[int]:
    """Bin counts at which blocks start, and the end; few bins leave most values together:
    blocks grow with the bin counts."""
    out = [1]
    while out[-1] <= most:
        out.append(min(most + 1, out[-1] + min(BLOCK, max(64, out[-1] // 8))))
    return out


def _binned(most: int, strides: int):
    """For each number of bins: the sum of c log c over bins that a piece holds whole
    (``bin`` -1), and its counts in the first and the last bin, which others may share.
    A piece takes every ``strides``-th block.

    A value further than a bin's width from both neighbours has a bin of its own, so only
    the others (and both ends) are put into bins: for finer bins ever fewer.  They are
    sorted, so a bin is a run, and its count a difference of running counts."""
    starts = _block_starts(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                z = batch.column(0).slice(i, 1).flatten().to_numpy()
                c = batch.column(1).slice(i, 1).flatten().to_numpy()
                first = batch.column(2)[i].as_py()
                n = int(c.sum())
                known = _c_log_c(np.arange(n + 1)) if n < LOOKED_UP else None
                alone, gaps = float(_c_log_c(c).sum()), np.diff(z)
                for low, high in list(zip(starts, starts[1:], strict=False))[first::strides]:
                    yield _block(z, c, gaps, alone, known, low, high)

    return run


def _block(z: np.ndarray, c: np.ndarray, gaps: np.ndarray, alone: float, known: np.ndarray | None, low: int, high: int) -> pa.RecordBatch:
    close = np.zeros(len(z), bool)
    close[[0, -1]] = True
    near = gaps * low < APART  # may share a bin for the coarsest bins here
    close[1:] |= near
    close[:-1] |= near
    z, c = z[close], c[close]
    upto = np.concatenate([[0], np.cumsum(c)])
    lonely = alone - float(_c_log_c(c).sum())
    bins = np.arange(low, high, dtype=np.int64)
    first, last = (np.minimum(np.floor(v * bins), bins - 1).astype(np.int64) for v in (z[0], z[-1]))
    whole, head, tail = (np.zeros(len(bins)) for _ in range(3))
    at, change = np.empty(len(z)), np.ones(len(z) + 1, bool)
    for j, b in enumerate(bins.tolist()):
        np.floor(np.multiply(z, b, out=at), out=at)
        at[-1] = min(at[-1], b - 1.0)  # the greatest value of all
        if len(at) > 1 and at[-2] > at[-1]:
            np.minimum(at, b - 1.0, out=at)
        np.not_equal(at[1:], at[:-1], out=change[1:-1])
        counts = np.diff(upto[np.flatnonzero(change)])
        head[j] = counts[0]
        if len(counts) > 1:
            tail[j] = counts[-1]
        inner = counts[1:-1]
        whole[j] = lonely + (known[inner] if known is not None else _c_log_c(inner)).sum()
    two = last > first
    return pa.record_batch(
        [
            pa.array(np.concatenate([bins, bins, bins[two]])),
            pa.array(np.concatenate([np.full(len(bins), -1), first, last[two]])),
            pa.array(np.concatenate([whole, head, tail[two]])),
        ],
        ["bins", "bin", "v"],
    )


def penalised_likelihood(df: DataFrame, x: str, most_bins: int | None = None) -> DataFrame:
    """``bins``, ``likelihood``: Birge and Rozenholc's criterion for 1 to ``most_bins``
    equal bins between the extremes, by default to one fewer than there are rows.

    Equal values are counted, sorted by ranges and cut into pieces; each piece is dealt
    to some tasks that share the bin counts, sums the bins that lie inside it and hands on
    its counts in its first and last bin, which are added to its neighbours'.
    A value alone in its bin is known from the gaps beside it; the work is the different
    values that may share one, for each bin count, and the memory of a task one piece.
    Nulls and NaN are left out; equal values only, or fewer than two, give no rows.
    """
    rows = df.select(clean(x).alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("c"))
    n, low, high = rows.agg(F.sum("c"), F.min("x"), F.max("x")).first()
    if not n or low == high:
        return df.sparkSession.createDataFrame([], "bins long, likelihood double")
    most = most_bins or n - 1
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    z = (F.col("x") - low) / (high - low)
    ranged = rows.select(z.alias("z"), "c").repartitionByRange(parts, "z").sortWithinPartitions("z")
    pieces = staged(ranged.mapInArrow(_pieces, "z array<double>, c array<long>"), "pieces")
    # each piece is sent to as many tasks as give them all work, not once for each block
    strides = -(-WAVES * parts // max(1, pieces.count()))
    dealt = pieces.select("z", "c", F.explode(F.sequence(F.lit(0), F.lit(strides - 1))).alias("first"))
    dealt = dealt.repartition(WAVES * parts, "first", F.get("z", 0))
    parted = staged(dealt.mapInArrow(_binned(most, strides), "bins long, bin long, v double"), "binned")
    whole = parted.where("bin < 0").groupBy("bins").agg(F.sum("v").alias("v"))
    shared = parted.where("bin >= 0").groupBy("bins", "bin").agg(F.sum("v").alias("c"))
    shared = shared.groupBy("bins").agg(F.sum(F.col("c") * F.log("c")).alias("v"))
    d = F.col("bins").cast("double")
    penalty = d - 1 + F.pow(F.log(d), F.lit(2.5))
    fit = F.sum("v") + F.lit(float(n)) * F.log(d / F.lit(float(n)))
    return whole.union(shared).groupBy("bins").agg(fit.alias("f")).select("bins", (F.col("f") - penalty).alias("likelihood"))


def best_histogram(df: DataFrame, x: str, most_bins: int | None = None) -> DataFrame:
    best = penalised_likelihood(df, x, most_bins).orderBy(F.desc("likelihood"), "bins").first()
    return histogram(df, x, best["bins"] if best else 1)
