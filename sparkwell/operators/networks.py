"""Random-vector functional-link nets, Hopfield memories, projection smoothers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clean
from ..functions.special import unpack_bits
from .linear import gram


@dataclass(frozen=True)
class LinkNet:
    """A random hidden layer beside the inputs, and ridge weights on both."""

    features: list[str]
    hidden: np.ndarray  # columns: constant and features
    weights: np.ndarray

    def inputs(self, activation: Callable[[Column], Column]) -> list[Column]:
        x = [clean(c) for c in self.features]
        layer = []
        for row in self.hidden:
            z = F.lit(float(row[0]))
            for c, w in zip(x, row[1:], strict=True):
                z = z + float(w) * c
            layer.append(activation(z))
        return [F.lit(1.0), *x, *layer]

    def predict(self, activation: Callable[[Column], Column] = F.tanh) -> Column:
        out = F.lit(0.0)
        for c, w in zip(self.inputs(activation), self.weights, strict=True):
            out = out + float(w) * c
        return out


def fit_link_net(df: DataFrame, y: str, features: list[str], hidden: int = 8, ridge: float = 1e-3, seed: int = 1, activation: Callable[[Column], Column] = F.tanh) -> LinkNet:
    """One Gram job whatever the rows, then a solve of its size."""
    rng = np.random.default_rng(seed)
    net = LinkNet(features, rng.normal(size=(hidden, len(features) + 1)), np.zeros(0))
    g = gram(df, [*net.inputs(activation), y])
    p = len(g) - 1
    return LinkNet(features, net.hidden, np.linalg.solve(g[:p, :p] + ridge * np.eye(p), g[:p, p]))


@dataclass(frozen=True)
class Hopfield:
    weights: np.ndarray

    def energy(self, pattern: int) -> float:
        s = _signs(pattern, len(self.weights))
        return float(-0.5 * s @ self.weights @ s)

    def recall(self, pattern: int, most: int = 100) -> int:
        """Updates all bits in turn until none changes."""
        s = _signs(pattern, len(self.weights))
        for _ in range(most):
            before = s.copy()
            for i in range(len(s)):
                h = self.weights[i] @ s
                s[i] = s[i] if h == 0 else np.sign(h)
            if (s == before).all():
                break
        return sum(1 << i for i, v in enumerate(s) if v > 0)


def _signs(pattern: int, width: int) -> np.ndarray:
    return np.array([1.0 if pattern >> i & 1 else -1.0 for i in range(width)])


def hebbian_weights(df: DataFrame, pattern: str, width: int = 16) -> DataFrame:
    """``i``, ``j``, ``w``: mean products of the patterns' signs.  Patterns are
    counted first; sums are over bits, so any number of patterns adds up."""
    signs = F.transform(unpack_bits(F.col(pattern), width), lambda b: 2 * b - 1)
    rows = df.where(F.col(pattern).isNotNull()).groupBy(pattern).agg(F.count("*").alias("c")).select("c", signs.alias("s"))
    left = rows.select("c", "s", F.posexplode("s").alias("i", "a"))
    both = left.select("c", "i", "a", F.posexplode("s").alias("j", "b")).where("i <> j")
    n = df.where(F.col(pattern).isNotNull()).count()
    return both.groupBy("i", "j").agg((F.sum(F.col("c") * F.col("a") * F.col("b")) / float(max(1, n))).alias("w"))


def train_hopfield(df: DataFrame, pattern: str, width: int = 16) -> Hopfield:
    w = np.zeros((width, width))
    for r in hebbian_weights(df, pattern, width).collect():  # width squared rows
        w[r["i"], r["j"]] = r["w"]
    return Hopfield(w)


def projection_smoother(df: DataFrame, key: str, y: str, features: list[str], projections: int = 5, neighbours: int = 16, seed: int = 1) -> DataFrame:
    """``key``, ``smooth``: along each random direction the median of ``y`` over the
    neighbouring ranks, then the median over directions."""
    from .timeseries import shifted

    rng = np.random.default_rng(seed)
    rows = df.select(key, clean(y).alias("_y"), *[clean(c).alias(c) for c in features]).dropna()
    out = None
    for _ in range(projections):
        d = rng.normal(size=len(features))
        d /= np.linalg.norm(d)
        along = sum((float(w) * F.col(c) for w, c in zip(d, features, strict=True)), F.lit(0.0))
        # the key makes the order total
        placed = rows.select(key, "_y", F.struct(along.alias("a"), F.col(key).alias("k")).alias("_o"))
        half = neighbours // 2
        near = shifted(placed, "_y", "_o", list(range(-half, half + 1)))
        values = F.filter(F.array(*[f"_s{i}" for i in range(2 * half + 1)]), lambda v: v.isNotNull())
        part = near.select(key, _array_median(values).alias("m"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.median("m").alias("smooth"))


def _array_median(xs: Column) -> Column:
    s, n = F.array_sort(xs), F.size(xs)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def self_projection_smoother(df: DataFrame, key: str, columns: list[str], projections: int = 5, neighbours: int = 16, seed: int = 1) -> DataFrame:
    """Each column smoothed along directions of the others: ``key`` and the columns."""
    out = df.select(key)
    for i, c in enumerate(columns):
        others = [o for o in columns if o != c]
        out = out.join(projection_smoother(df, key, c, others, projections, neighbours, seed + i).withColumnRenamed("smooth", c), key)
    return out
