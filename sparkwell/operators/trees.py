"""Regression trees and forests.

Single trees grow level by level: one aggregation over the data gives, for every
open node, feature and bin, the sums that all split rules need, so a level is one
job and rows never leave their tasks.  Forests of random trees are in ``forests``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clean, uniform


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float
    left: tuple[float, float]  # constant and slope on the feature
    right: tuple[float, float]
    kind: str


@dataclass
class Tree:
    """Nodes by number (children of i: 2i+1, 2i+2).  A node adds its piece to the
    prediction; predictions are clamped to the training range widened by ``slack``."""

    features: list[str]
    base: float
    bounds: tuple[float, float]
    splits: dict[int, Split] = field(default_factory=dict)

    def node(self) -> Column:
        at = F.lit(0)
        for i in sorted(self.splits):
            s = self.splits[i]
            side = F.when(clean(self.features[s.feature]) <= s.threshold, 2 * i + 1).otherwise(2 * i + 2)
            at = F.when(at == i, side).otherwise(at)
        return at

    def predict(self) -> Column:
        """One expression; nothing is sent or shuffled."""
        at, total = F.lit(0), F.lit(self.base)
        for i in sorted(self.splits):
            s = self.splits[i]
            x = clean(self.features[s.feature])
            goes_left = x <= s.threshold
            piece = F.when(goes_left, s.left[0] + s.left[1] * x).otherwise(s.right[0] + s.right[1] * x)
            total = total + F.when(at == i, piece).otherwise(F.lit(0.0))
            at = F.when(at == i, F.when(goes_left, 2 * i + 1).otherwise(2 * i + 2)).otherwise(at)
        return F.least(F.lit(self.bounds[1]), F.greatest(F.lit(self.bounds[0]), total))


def _line(s: np.ndarray) -> tuple[float, float, float]:
    """Constant, slope and residual sum of squares from n, x, y, xx, xy, yy."""
    n, x, y, xx, xy, yy = s
    sxx, sxy, syy = xx - x * x / n, xy - x * y / n, yy - y * y / n
    if sxx <= 1e-12 * max(1.0, xx):
        return y / n, 0.0, max(syy, 0.0)
    b = sxy / sxx
    return (y - b * x) / n, b, max(syy - b * sxy, 0.0)


def _constant(s: np.ndarray) -> tuple[float, float, float]:
    return s[2] / s[0], 0.0, max(s[5] - s[2] ** 2 / s[0], 0.0)


def _best(node: dict[int, dict[int, np.ndarray]], cuts: list[list[float]], rules: tuple[str, ...], least: int) -> tuple[float, Split] | None:
    """Lowest Bayesian information criterion over features, cuts and rules; none if
    no split is better than the constant."""
    best: tuple[float, Split] | None = None
    for feature, bins in node.items():
        total = sum(bins.values())
        n = total[0]
        bic = lambda rss, k: n * math.log(max(rss / n, 1e-12)) + k * math.log(n)  # noqa: E731, B023
        stay = bic(_constant(total)[2], 1)
        if "linear" in rules:
            a, b, rss = _line(total)
            found = bic(rss, 2)
            if found < stay - 1e-9 and (best is None or found < best[0]):
                best = found, Split(feature, math.inf, (a, b), (a, b), "linear")
        run = np.zeros(6)
        for k in sorted(bins)[:-1]:
            run = run + bins[k]
            rest = total - run
            if run[0] < least or rest[0] < least:
                continue
            for rule, fit, df in (("constant", _constant, 5), ("lines", _line, 7)):
                if rule not in rules:
                    continue
                left, right = fit(run), fit(rest)
                found = bic(left[2] + right[2], df)
                if found < stay - 1e-9 and (best is None or found < best[0]):
                    best = found, Split(feature, cuts[feature][k], left[:2], right[:2], rule)
    return best


def grow_tree(df: DataFrame, y: str, features: list[str], depth: int = 4, bins: int = 32, least: int = 20, rules: tuple[str, ...] = ("constant",), slack: float = 3.0, weight: str | None = None) -> Tree:
    """A tree by the Bayesian information criterion, on residuals level by level.

    ``rules``: ``constant`` (two constants), ``linear`` (one line) and ``lines``
    (two lines); with all three it is a linear model tree.  Cuts lie at
    approximate quantiles of the features.
    """
    rows = df.select(clean(y).alias("_y"), *[clean(c).alias(c) for c in features], (clean(weight) if weight else F.lit(1.0)).alias("_w")).dropna()
    n, low, high, mean = rows.agg(F.count("*"), F.min("_y"), F.max("_y"), F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).first()
    if not n:
        return Tree(features, 0.0, (0.0, 0.0))
    half, mid = (high - low) / 2, (high + low) / 2
    tree = Tree(features, float(mean), (mid - slack * half, mid + slack * half))
    q = rows.approxQuantile(features, [i / bins for i in range(1, bins)], 0.001)
    cuts = [sorted(set(c)) for c in q]
    place = [sum((F.when(F.col(c) > v, 1).otherwise(0) for v in cut), F.lit(0)) for c, cut in zip(features, cuts, strict=True)]
    open_nodes = {0}
    for _ in range(depth):
        r = F.col("_y") - tree.predict()
        each = rows.select(
            tree.node().alias("node"), r.alias("r"), "_w",
            F.explode(F.array(*[F.struct(F.lit(j).alias("f"), F.col(c).alias("x"), p.alias("b")) for j, (c, p) in enumerate(zip(features, place, strict=True))])).alias("c"),
        ).where(F.col("node").isin([*open_nodes]))
        x, w = F.col("c.x"), F.col("_w")
        sums = each.groupBy("node", F.col("c.f").alias("f"), F.col("c.b").alias("b")).agg(
            F.sum(w), F.sum(w * x), F.sum(w * F.col("r")), F.sum(w * x * x), F.sum(w * x * F.col("r")), F.sum(w * F.col("r") * F.col("r"))
        )
        found: dict[int, dict[int, dict[int, np.ndarray]]] = {}
        for node, f, b, *s in sums.collect():  # nodes x features x bins rows
            found.setdefault(node, {}).setdefault(f, {})[b] = np.array(s, float)
        following = set()
        for node, by in sorted(found.items()):
            best = _best(by, cuts, rules, least)
            if best:
                tree.splits[node] = best[1]
                following |= {2 * node + 1} if best[1].kind == "linear" else {2 * node + 1, 2 * node + 2}
        open_nodes = following
        if not following:
            break
    return tree


def grow_model_forest(df: DataFrame, key: str, y: str, features: list[str], trees: int = 5, share: float = 0.63, seed: int = 1, **kw) -> list[Tree]:
    """Trees on random parts of the rows (``share``, by hashed keys) and random pairs
    of features; with ``rules`` of constants and lines, a forest of linear model
    trees.  Each level of each tree is one aggregation over all its rows."""
    rng = np.random.default_rng(seed)
    out = []
    for t in range(trees):
        chosen = sorted(rng.choice(len(features), min(len(features), max(2, len(features) // 2)), replace=False))
        part = df.where(uniform(seed, key, F.lit(t)) < share)
        out.append(grow_tree(part, y, [features[i] for i in chosen], **kw))
    return out


def model_forest_predict(forest: list[Tree]) -> Column:
    """Mean prediction, one expression."""
    total = forest[0].predict()
    for t in forest[1:]:
        total = total + t.predict()
    return total / len(forest)
