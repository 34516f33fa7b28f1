"""Linear algebra on data: one aggregation gives the Gram matrix, the driver
solves what is left, whose size is the number of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clean, col


#: Columns beyond which sums are not spelled out one by one.
WIDE = 16


def gram(df: DataFrame, columns: list[Column | str], weight: Column | str | None = None) -> np.ndarray:
    """Matrix of the (weighted) sums of products of the columns; rows with a
    missing value are left out.  ``p (p + 1) / 2`` sums in one job."""
    parts = [clean(c) for c in columns]
    w = clean(weight) if weight is not None else F.lit(1.0)
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(parts)], w.alias("w")).dropna()
    p = len(parts)
    if p > WIDE:
        return _wide_gram(rows, p)
    sums = [F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    row = rows.agg(*sums).first()
    out = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return out


def _wide_gram(rows: DataFrame, p: int) -> np.ndarray:
    """The same sums by matrix products of Arrow batches.  Each task adds up its
    own and gives one row for each pair of columns."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            total += x[:, :p].T @ (x[:, :p] * x[:, p:])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * p), pa.int32()), pa.array(total.ravel())], ["k", "s"])

    sums = rows.mapInArrow(summed, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(p * p)
    for r in sums:
        out[r["k"]] = r["s"]
    return out.reshape(p, p)


def matrix_frame(spark, m: np.ndarray) -> DataFrame:
    """``i``, ``j``, ``v`` of a small matrix."""
    m = np.atleast_2d(m)
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i int, j int, v double")


def qr_r(df: DataFrame, columns: list[str]) -> np.ndarray:
    """R of the thin QR decomposition, with a positive diagonal."""
    return np.linalg.cholesky(gram(df, columns)).T


def qr_q(df: DataFrame, columns: list[str], prefix: str = "q") -> DataFrame:
    """``df`` with the columns of Q: X times the inverse of R, where the rows lie."""
    inverse = np.linalg.inv(qr_r(df, columns))
    return df.select(
        "*",
        *[
            sum((float(inverse[i, j]) * col(c) for i, c in enumerate(columns)), F.lit(0.0)).alias(f"{prefix}{j}")
            for j in range(len(columns))
        ],
    )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)


def _triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """R of all rows of a task, one batch after the other, as rows."""
    r = None
    for batch in batches:
        if len(batch):
            x = _matrix(batch)
            r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in r.T], [f"c{j}" for j in range(r.shape[1])])


#: Tasks of the second step of a reduction of triangles.
FAN_IN = 64


def _positive(r: np.ndarray) -> np.ndarray:
    """R with a diagonal that is not negative."""
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def tall_skinny_r(df: DataFrame, columns: list[Column | str]) -> np.ndarray:
    """R of the thin QR decomposition by Householder reflections, with a positive
    diagonal: each task reduces its rows to a triangle, ``FAN_IN`` tasks reduce the
    triangles, and the driver what they leave.  Unlike Cholesky's root of the Gram matrix
    it does not square the condition number.  Rows with a missing value are left out;
    fewer rows than columns give rows of zeros."""
    p = len(columns)
    rows = df.select(*[clean(c).alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    shape = ", ".join(f"c{j} double" for j in range(p))
    some = rows.mapInArrow(_triangle, shape).repartition(FAN_IN).mapInArrow(_triangle, shape)
    left = np.array([list(r) for r in some.collect()], float).reshape(-1, p)  # p rows a task of the second step
    r = np.linalg.qr(np.vstack([left, np.zeros((p, p))]), mode="r")
    return _positive(r)


def tall_skinny_qr(df: DataFrame, columns: list[str], prefix: str = "q") -> tuple[DataFrame, np.ndarray]:
    """``df`` with the columns of Q, and R, of the thin QR decomposition.

    X over R is orthogonal only as far as the condition number lets it; decomposing
    that once more (its condition is near one) makes it so to the last digits.  Two
    reductions, and one product where the rows lie.  Linearly dependent columns raise
    a LinAlgError.
    """
    p = len(columns)
    first = tall_skinny_r(df, [*columns])
    names = [f"_{prefix}{j}" for j in range(p)]

    def over(rows: DataFrame, r: np.ndarray, source: list[str], target: list[str]) -> DataFrame:
        # forward substitution, as rounding errors of an inverse would stay in Q
        if not (np.abs(np.diag(r)) > 100 * np.finfo(float).eps * np.abs(r).max()).all():
            raise np.linalg.LinAlgError("columns are linearly dependent")
        for j, t in enumerate(target):
            value = col(source[j])
            for i in range(j):
                value = value - F.col(target[i]) * float(r[i, j])
            rows = rows.withColumn(t, value / float(r[j, j]))
        return rows

    near = over(df, first, columns, names)
    second = tall_skinny_r(near, [*names])
    return over(near, second, names, [f"{prefix}{j}" for j in range(p)]).drop(*names), second @ first


def outer_product(df: DataFrame, key: str, columns: list[str], queries: DataFrame) -> DataFrame:
    """Rows of ``X X'`` for the rows of ``queries``: ``key``, ``query``, ``v``."""
    from .neighbors import pairs

    other = queries.select(F.col(key).alias("query"), F.struct(*columns).alias("q"))
    product = sum((F.col(c) * F.col("q")[c] for c in columns), F.lit(0.0))
    return pairs(other, df).select(key, "query", product.alias("v"))


def covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Population covariances."""
    g = gram(df, [*columns, F.lit(1.0)])
    n, s = g[-1, -1], g[-1, :-1]
    return g[:-1, :-1] / n - np.outer(s, s) / n**2


def correlation(df: DataFrame, columns: list[str]) -> np.ndarray:
    c = covariance(df, columns)
    d = np.sqrt(np.diag(c))
    return c / np.outer(d, d)


def inverse_symmetric(m: np.ndarray) -> np.ndarray:
    """By Cholesky's factor."""
    r = np.linalg.inv(np.linalg.cholesky(m))
    return r.T @ r


def inverse_upper(r: np.ndarray) -> np.ndarray:
    return np.linalg.solve(r, np.eye(len(r)))


def sqrt_upper(r: np.ndarray) -> np.ndarray:
    """Upper triangular square root of an upper triangular matrix with a positive
    diagonal, column by column."""
    n = len(r)
    u = np.zeros_like(r, float)
    for j in range(n):
        u[j, j] = np.sqrt(r[j, j])
        for i in range(j - 1, -1, -1):
            u[i, j] = (r[i, j] - u[i, i + 1 : j] @ u[i + 1 : j, j]) / (u[i, i] + u[j, j])
    return u


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``perm``, L and U with ``a[perm] = L U``, by partial pivoting."""
    u, n = np.array(a, float), len(a)
    low, perm = np.eye(n), np.arange(n)
    for k in range(n):
        p = k + int(np.argmax(np.abs(u[k:, k])))
        u[[k, p]], perm[[k, p]] = u[[p, k]], perm[[p, k]]
        low[[k, p], :k] = low[[p, k], :k]
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return perm, low, np.triu(u)


def lu_solve(perm: np.ndarray, low: np.ndarray, up: np.ndarray, b: np.ndarray) -> np.ndarray:
    y = np.zeros(len(b))
    for i in range(len(b)):
        y[i] = b[perm[i]] - low[i, :i] @ y[:i]
    x = np.zeros(len(b))
    for i in range(len(b) - 1, -1, -1):
        x[i] = (y[i] - up[i, i + 1 :] @ x[i + 1 :]) / up[i, i]
    return x


def determinant(a: np.ndarray) -> float:
    return float(np.linalg.det(a))


def log_determinant(a: np.ndarray) -> float:
    return float(np.linalg.slogdet(a)[1])


def minor(a: np.ndarray, i: int, j: int) -> np.ndarray:
    return np.delete(np.delete(a, i, 0), j, 1)


def dominant_eigenvector(a: np.ndarray, power_steps: int = 50, steps: int = 20) -> np.ndarray:
    """Power method, then Rayleigh quotient iteration; the largest part positive."""
    v = np.ones(len(a)) / np.sqrt(len(a))
    for _ in range(power_steps):
        v = a @ v
        v /= np.linalg.norm(v)
    for _ in range(steps):
        mu = v @ a @ v
        try:
            w = np.linalg.solve(a - mu * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            break
        w /= np.linalg.norm(w)
        done = abs(abs(w @ v) - 1) < 1e-15
        v = w
        if done:
            break
    return v * np.sign(v[np.argmax(np.abs(v))])


def inner_upper(r: np.ndarray) -> np.ndarray:
    """``R' R`` of an upper triangular matrix."""
    return np.triu(r).T @ np.triu(r)


def outer_upper(r: np.ndarray) -> np.ndarray:
    """``R R'`` of an upper triangular matrix."""
    return np.triu(r) @ np.triu(r).T
