"""Whitening of embeddings from a compensated covariance.

Entries become whole numbers, so counts and sums are exact.  Rows are centred with a
mean of two doubles.  Outer products of centred rows are summed in blocks: each row is
cut into slices of so few bits that a matrix product of slices is exact (the error-free
transformation of Ozaki et al., 2012), and block sums are added as double-double numbers
by error-free additions.  Tasks hand on high and low parts, row by row, which are
merged likewise.  The covariance matrix, as large as the dimension, is solved on the driver by
LAPACK's tridiagonal divide and conquer, and one step of Ogita and Aishima (2018) in
extended precision takes its eigenvectors to the last bits of a double.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import narrow_batches, staged

#: Components that are returned.
COMPONENTS = 8
#: Entries of at least this size would leave the whole numbers that doubles hold.
TOO_LARGE = float(1 << 31)
#: Rows of a block of outer products, and bits of a slice: 2 * 21 + 11 = 53.
BLOCK, SLICE_BITS = 2048, 21


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-double numbers."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def _sliced(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """``high + low`` of each column as three slices: two of at most 21 bits, the rest."""
    out = []
    rest, tail = high, low
    for _ in range(2):
        most = np.abs(rest).max(axis=0)
        unit = np.ldexp(1.0, np.frexp(most)[1] - SLICE_BITS)
        part = np.rint(rest / unit) * unit
        out.append(part)
        rest, tail = two_sum(rest - part, tail)
    return [*out, rest]


def outer_sum(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the outer products of rows ``high + low`` as a double-double matrix."""
    d = high.shape[1]
    total = np.zeros((d, d)), np.zeros((d, d))
    for at in range(0, len(high), BLOCK):
        a, b, c = _sliced(high[at : at + BLOCK], low[at : at + BLOCK])
        ab, ac = a.T @ b, a.T @ c + b.T @ c
        for exact in (a.T @ a, ab, ab.T, b.T @ b, ac, ac.T, c.T @ c):
            total = add(total, (exact, np.zeros((d, d))))
    return total


def _whole(column: pa.Array, d: int | None = None) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """Row numbers and whole numbers of the usable vectors, by length (only ``d``)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = []
    for k in np.unique(sizes[sizes > 0]) if d is None else [d]:
        at = np.flatnonzero(sizes == k)
        entries = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        entries = entries.reshape(len(at), int(k))
        good = (np.abs(entries) < TOO_LARGE).all(axis=1)  # false for NaN, which a null is here
        out.append((at[good], (np.floor(1024 * entries[good]) + 100_000).astype(np.int64)))
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for at, x in _whole(batch.column(0)):
            if len(at):
                n, s = found.get(x.shape[1], (0, 0))
                found[x.shape[1]] = n + len(at), s + x.sum(axis=0)
    for d, (n, s) in found.items():
        yield pa.record_batch([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.int64()))], ["d", "n", "s"])


@dataclass(frozen=True)
class Fit:
    """Whitening of vectors of length ``d`` from ``n`` of them with sums ``s``: the mean
    is ``mean[0] + mean[1]``; ``weights`` are eigenvectors over the roots of their
    eigenvalues, NaN where an eigenvalue is zero; ``explained`` are shares of the trace."""

    d: int
    n: int
    s: np.ndarray
    mean: tuple[np.ndarray, np.ndarray]
    weights: np.ndarray
    explained: np.ndarray


def _mean(s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    high = np.array([int(v) / n for v in s])
    parts = [h.as_integer_ratio() for h in high.tolist()]
    low = np.array([(int(v) * q - p * n) / (q * n) for v, (p, q) in zip(s, parts, strict=True)])
    return high, low


def _centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    high, low = two_sum(x.astype(float), -mean[0])
    return two_sum(high, low - mean[1])


def covariance(vectors: DataFrame, x: str, d: int, n: int, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Covariance, divisor ``n``, in extended precision."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d)), np.zeros((d, d))
        for batch in batches:
            for _, whole in _whole(batch.column(0), d):
                if len(whole):
                    total = add(total, outer_sum(*_centred(whole, mean)))
        yield _rows(dict(enumerate(zip(*total, strict=True))))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            high, low = (batch.column(c).flatten().to_numpy().reshape(-1, d) for c in (1, 2))
            for k, i in enumerate(batch.column(0).to_pylist()):
                row = high[k], low[k]
                held[i] = add(held[i], row) if i in held else row
        if held:
            yield _rows(held)

    row = "i int, high array<double>, low array<double>"
    rows = vectors.select(x).mapInArrow(task, row).repartition("i").mapInArrow(merged, row).orderBy("i").collect()  # one row a dimension
    high, low = (np.array([r[c] for r in rows], np.longdouble) for c in ("high", "low"))
    return (high + low) / n


def _rows(held: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    parts = [pa.array([r[k].tolist() for r in held.values()], pa.list_(pa.float64())) for k in (0, 1)]
    return pa.record_batch([pa.array(held.keys(), pa.int32()), *parts], ["i", "high", "low"])


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a = (a + a.T) / 2
    e, u = np.linalg.eigh(a.astype(float))  # dsyevd: tridiagonal form, divide and conquer
    v = u.astype(np.longdouble)
    r = np.eye(len(a), dtype=np.longdouble) - v.T @ v
    s = v.T @ (a @ v)
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= 1e-12 * max(float(np.abs(values).max(initial=0.0)), 1e-300)
    step = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    v = v + v @ step
    v /= np.sqrt((v * v).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float), v[:, order].astype(float)


def fit(vectors: DataFrame, x: str, components: int = COMPONENTS) -> Fit | None:
    """The whitening of all usable vectors; None if there are none."""
    narrow_batches(vectors.sparkSession)
    sums = staged(vectors.select(x).mapInArrow(_sums, "d int, n long, s array<long>"), "sums")
    best = sums.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    d, n = best["d"], best["n"]
    each = sums.where(F.col("d") == d).select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    s = np.array([r["v"] for r in each.orderBy("i").collect()], dtype=np.int64)  # one row a dimension
    mean = _mean(s, n)
    matrix = covariance(vectors, x, d, n, mean)
    e, u = eigen(matrix)
    trace = float(np.trace(matrix))
    k = min(components, d)
    weights = np.full((d, k), np.nan)
    good = e[:k] > d * 2.0**-52 * max(e[0], 0.0)
    weights[:, good] = u[:, :k][:, good] / np.sqrt(e[:k][good])
    return Fit(d, n, s, mean, weights, np.maximum(e[:k], 0.0) / trace if trace > 0 else np.full(k, np.nan))


def _deviation(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """Sum of (n x - s)^2 of each row, exactly; None beyond 64 bits."""
    if n * int(np.abs(x).max(initial=0)) + int(np.abs(s).max(initial=0)) < 1 << 62:
        off = n * x - s
        if int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (off**2).sum(axis=1).tolist()
    rows = ((n * x.astype(object) - s.astype(object)) ** 2).sum(axis=1) if len(x) else []
    return [int(v) if v < 1 << 63 else None for v in rows]


def whitened_vectors(vectors: DataFrame, key: str, x: str, found: Fit) -> DataFrame:
    """``key``, ``deviation``, ``w`` (one whitened value a component) of usable vectors."""
    kind = vectors.schema[key].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, whole in _whole(batch.column(1), found.d):
                high, low = _centred(whole, found.mean)
                w = high @ found.weights + low @ found.weights
                values = pa.array(w.ravel(), pa.float64(), from_pandas=True)  # NaN is null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * w.shape[1], pa.int32()), values)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(_deviation(whole, found.n, found.s), pa.int64()), lists], [key, "deviation", "w"])

    return vectors.select(key, x).mapInArrow(task, f"`{key}` {kind.simpleString()}, deviation long, w array<double>")


def identity_error(whitened: DataFrame, n: int, k: int) -> float | None:
    """Largest absolute entry of the covariance of ``w`` less the identity, over the
    components that are defined; one aggregation."""
    at = [F.get("w", i) for i in range(k)]
    means = [v or 0.0 for v in whitened.agg(*[F.avg(c) for c in at]).first()]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = whitened.agg(*[F.sum((at[i] - means[i]) * (at[j] - means[j])) for i, j in pairs]).first()
    off = [abs(v / n - (i == j)) for (i, j), v in zip(pairs, sums, strict=True) if v is not None]
    return max(off, default=None)


def whiten(vectors: DataFrame, key: str = "vec_id", x: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error`` for each usable vector and component.

    Dropped are vectors that are null, empty or hold null, NaN, infinite entries or
    entries of 2^31 or more, and those whose length is not the commonest (the longest
    of equals).  Repeated rows and null keys stay.  Components with a zero eigenvalue
    (one vector, equal vectors, fewer vectors than components) have a null ``whitened``
    and do not count in ``identity_error``; ``explained`` is null where the trace is zero,
    ``deviation`` where it exceeds a long.  No usable vectors give an empty table.  Other
    columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(vectors, x, components)
    if found is None:
        return spark.createDataFrame([], shape)
    rows = staged(whitened_vectors(vectors, key, x, found), "whitened")
    k = found.weights.shape[1]
    error = identity_error(rows, found.n, k)
    shares = F.array(*[F.lit(None if np.isnan(v) else float(v)).cast("double") for v in found.explained])
    out = rows.select(key, "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        key, (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
