"""Isolation forests.

A bounded number of rows, ``trees * psi``, is drawn by hashed keys; trees are
grown on the driver and sent to the tasks, which score Arrow batches where the
rows lie.  Nothing is shuffled to score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import uniform

Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]


def c_factor(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n``."""
    if n <= 1:
        return 0.0
    h = math.log(n - 1) + 0.5772156649015329 if n > 2 else 1.0
    return 2 * h - 2 * (n - 1) / n


def l2(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p) ** 2).sum(-1))


@dataclass(frozen=True)
class Node:
    """A leaf of ``size`` rows, or a cut: ``rule(x) <= threshold`` goes left."""

    size: int = 0
    rule: tuple = ()
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass(frozen=True)
class Forest:
    kind: str
    psi: int
    trees: list[Node] = field(default_factory=list)
    nets: list[list[np.ndarray]] = field(default_factory=list)

    def _value(self, rule: tuple, x: np.ndarray) -> np.ndarray:
        if rule[0] == "projection":
            return x @ rule[1]
        if rule[0] == "prototype":
            return l2(x, rule[1])
        # Steinhaus transform of two prototypes with the row as the pivot
        d = l2(rule[1], rule[2])
        return 2 * d / np.maximum(d + l2(x, rule[1]) + l2(x, rule[2]), 1e-300)

    def depths(self, node: Node, x: np.ndarray, depth: int = 0) -> np.ndarray:
        if not node.rule:
            return np.full(len(x), depth + c_factor(node.size))
        left = self._value(node.rule, x) <= node.threshold
        out = np.empty(len(x))
        out[left] = self.depths(node.left, x[left], depth + 1) if left.any() else 0
        out[~left] = self.depths(node.right, x[~left], depth + 1) if (~left).any() else 0
        return out

    def score(self, x: np.ndarray, combine: str = "mean_depth") -> np.ndarray:
        """``mean_depth``: 2^(-mean h / c); ``mean_score``: mean of 2^(-h / c);
        ``conorm``: 1 - exp(mean ln(1 - 2^(-h / c)))."""
        c = max(c_factor(self.psi), 1e-12)
        h = np.array([self.depths(t, _net(self.nets[i], x) if self.nets else x) for i, t in enumerate(self.trees)]) / c
        if combine == "mean_depth":
            return 2.0 ** -h.mean(0)
        if combine == "mean_score":
            return (2.0**-h).mean(0)
        return 1 - np.exp(np.log1p(-np.minimum(2.0**-h, 1 - 1e-12)).mean(0))


def _net(layers: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """A random complex-valued net; its output's real and imaginary parts."""
    z = x.astype(complex)
    for w in layers:
        z = z @ w
        size = np.abs(z)
        z = z * np.log1p(size) / np.maximum(size, 1e-12)
    return np.concatenate([z.real, z.imag], axis=1)


def _rule(kind: str, x: np.ndarray, rng: np.random.Generator) -> tuple:
    if kind in ("projection", "gap", "deep"):
        v = rng.normal(size=x.shape[1])
        return ("projection", v / np.linalg.norm(v))
    if kind == "prototype":
        return ("prototype", x[rng.integers(len(x))])
    i, j = rng.choice(len(x), 2, replace=False)
    return ("steinhaus", x[i], x[j])


def grow(forest: Forest, x: np.ndarray, limit: int, rng: np.random.Generator) -> Node:
    if len(x) <= 1 or limit == 0 or (x == x[0]).all():
        return Node(len(x))
    rule = _rule(forest.kind, x, rng)
    v = forest._value(rule, x)
    low, high = v.min(), v.max()
    if low == high:
        return Node(len(x))
    if forest.kind == "gap":
        s = np.sort(v)
        k = int(np.argmax(np.diff(s)))
        threshold = s[k] + rng.random() * (s[k + 1] - s[k])
    elif forest.kind == "steinhaus":
        threshold = 0.5 if low <= 0.5 < high else (low + high) / 2
    else:
        threshold = low + rng.random() * (high - low)
    left = v <= threshold
    if left.all() or not left.any():
        return Node(len(x))
    return Node(0, rule, float(threshold), grow(forest, x[left], limit - 1, rng), grow(forest, x[~left], limit - 1, rng))


def isolation_forest(df: DataFrame, key: str, x: str, trees: int = 100, psi: int = 64, kind: str = "projection", limit: int | None = None, seed: int = 1) -> Forest:
    """``kind``: ``projection`` (random direction, uniform cut), ``gap`` (cut inside
    the largest gap), ``prototype`` (distance from one row), ``steinhaus`` (far from
    two rows, by their distance) or ``deep`` (projections of a random complex net)."""
    n = max(1, df.count())
    share = min(1.0, trees * psi / n * 1.2)
    rows = df.where(uniform(seed, key) <= share).select(x).where(F.col(x).isNotNull()).collect()
    data = np.array([r[0] for r in rows], float)
    rng = np.random.default_rng(seed)
    forest = Forest(kind, min(psi, max(1, len(data))))
    if not len(data):
        return forest
    data = data[np.lexsort(data.T[::-1])]  # the draw does not depend on the order of rows
    for _ in range(trees):
        part = data[rng.choice(len(data), min(psi, len(data)), replace=False)]
        if kind == "deep":
            sizes = [data.shape[1], 16, 8]
            net = [(rng.normal(size=s) + 1j * rng.normal(size=s)) / math.sqrt(s[0]) for s in zip(sizes, sizes[1:], strict=False)]
            forest.nets.append(net)
            part = _net(net, part)
        forest.trees.append(grow(forest, part, limit or math.ceil(math.log2(max(2, psi))), rng))
    return forest


def anomaly_scores(df: DataFrame, key: str, x: str, forest: Forest, combine: str = "mean_depth") -> DataFrame:
    """``key``, ``score``; rows without a vector are left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            s = forest.score(np.array(p[x].tolist(), float), combine) if len(p) and forest.trees else np.zeros(len(p))
            yield pd.DataFrame({key: p[key], "score": s})

    return df.select(key, x).where(F.col(x).isNotNull()).mapInPandas(run, f"{key} {kind}, score double")


def autoscale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their median over the spread of their quartiles (its normal
    equivalent, or the mean absolute deviation where that is zero)."""
    q = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns]).first()
    mad = df.agg(*[F.avg(F.abs(F.col(c) - F.lit(q[c][1]))).alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        low, mid, high = q[c]
        scale = (high - low) / 1.3489795003921634 or mad[c] or 1.0
        out[c] = (F.col(c) - F.lit(mid)) / F.lit(float(scale))
    return df.withColumns(out)


def self_smoothing_matrix(df: DataFrame, key: str, columns: list[str], steps: int = 20, seed: int = 1) -> np.ndarray:
    """Each column regressed on the others by weighted least absolute residuals,
    with weights from the isolation score: a matrix with a zero diagonal."""
    from .glm import least_absolute

    rows = autoscale(df.select(key, *columns), columns).withColumn("_x", F.array(*columns))
    forest = isolation_forest(rows, key, "_x", trees=50, kind="deep", seed=seed)
    weighed = rows.join(anomaly_scores(rows, key, "_x", forest), key).withColumn("_w", 1 - F.col("score"))
    out = np.zeros((len(columns), len(columns)))
    for i, c in enumerate(columns):
        others = [o for o in columns if o != c]
        fit = least_absolute(weighed, c, others, "_w", steps)
        out[i, [j for j, o in enumerate(columns) if o != c]] = fit.coefficients
    return out
