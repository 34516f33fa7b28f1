"""Metrics of the user's over records of any type: proximity forests and Fréchet means.

A metric is a function of a batch of records (an Arrow struct array) and one record (a
dict) that gives an array of distances.  It runs in tasks where the rows lie; what is sent
to them are prototypes, a bounded number of records.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import uniform
from .iforest import c_factor

Record = dict[str, Any]
Metric = Callable[[pa.StructArray, Record], np.ndarray]
Oracle = Callable[[Record, int], list[Record]]
#: Rows of a task that are scored, in at most ``MOST_PARTS`` tasks: a small file takes long.
PART, MOST_PARTS = 20_000, 2000
#: Value of the transform of two prototypes up to which a record is far from both.
FAR = 0.5


@dataclass(frozen=True)
class Node:
    """A leaf of ``size`` records, or one or two ``prototypes``: records whose value
    is at most ``threshold`` go left."""

    size: int = 0
    prototypes: tuple[Record, ...] = ()
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


def node_value(x: pa.StructArray, prototypes: tuple[Record, ...], metric: Metric) -> np.ndarray:
    """The distance from one prototype; with two, Steinhaus's transform of their
    distance with the record as the pivot."""
    a = np.asarray(metric(x, prototypes[0]), float)
    if len(prototypes) == 1:
        return a
    b = np.asarray(metric(x, prototypes[1]), float)
    between = float(np.asarray(metric(pa.array([prototypes[0]], x.type), prototypes[1]), float)[0])
    return 2 * between / np.maximum(between + a + b, 1e-300)


def grow_node(x: pa.StructArray, kind: str, limit: int, metric: Metric, rng: np.random.Generator) -> Node:
    n = len(x)
    if n <= 1 or limit == 0:
        return Node(n)
    chosen = rng.choice(n, 1 if kind == "one" else 2, replace=False)
    prototypes = tuple(x[int(i)].as_py() for i in chosen)
    v = node_value(x, prototypes, metric)
    low, high = float(v.min()), float(v.max())
    if not low < high:
        return Node(n)
    threshold = low + rng.random() * (high - low) if kind == "one" else FAR if low <= FAR < high else (low + high) / 2
    left = v <= threshold
    sides = (x.filter(pa.array(s)) for s in (left, ~left))
    below, above = (grow_node(s, kind, limit - 1, metric, rng) for s in sides)
    return Node(0, prototypes, float(threshold), below, above)


def depths(node: Node, x: pa.StructArray, metric: Metric, depth: int = 0) -> np.ndarray:
    """Path length of each record, a leaf's size taken into account."""
    if not node.prototypes or not len(x):
        return np.full(len(x), depth + c_factor(node.size))
    left = node_value(x, node.prototypes, metric) <= node.threshold
    out = np.empty(len(x))
    out[left] = depths(node.left, x.filter(pa.array(left)), metric, depth + 1)
    out[~left] = depths(node.right, x.filter(pa.array(~left)), metric, depth + 1)
    return out


@dataclass(frozen=True)
class ProximityForest:
    psi: int
    trees: list[Node]


def _drawn(df: DataFrame, key: str, x: str, trees: int, psi: int, seed: int) -> DataFrame:
    """``tree``, ``x``: ``psi`` rows for each tree, fewer only if the table has fewer.

    Each row is offered to trees by hashed draws, so often that a tree is offered about
    twice as many rows as it takes (all, if the table is that small); it takes those with
    the least draws."""
    n = max(1, df.count())
    share = min(1.0, (2 * psi + 20) / n)
    rows = df.select(F.col(key).alias("_k"), F.col(x).alias("x"))
    if share * trees < 1:
        rows = rows.where(uniform(seed, "_k") < min(1.0, 2 * share * trees))
        share /= min(1.0, 2 * share * trees)
    offered = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("u", uniform(seed + 1, "_k", "tree"))
    order = Window.partitionBy("tree").orderBy("u", "_k")
    return offered.where(F.col("u") < share).withColumn("i", F.row_number().over(order)).where(F.col("i") <= psi).select("tree", "i", "x")


def proximity_forest(df: DataFrame, key: str, x: str, metric: Metric, trees: int = 50, psi: int = 30, kind: str = "one", limit: int | None = None, seed: int = 1) -> ProximityForest:
    """Trees of ``psi`` records each: ``kind`` ``one`` cuts at a random distance from
    one record, ``two`` at records far from two.  A tree is grown in a task of its own,
    which gets its ``psi`` records.  Rows whose record is null are left out; no rows give
    no trees."""
    rows = df.where(F.col(x).isNotNull())
    sample = _drawn(rows, key, x, trees, psi, seed)
    depth = limit or math.ceil(math.log2(max(2, psi)))

    def grow(k: tuple[Any, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        column = t.column("x").combine_chunks()
        records = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        tree = int(k[0].as_py())
        node = grow_node(records, kind, depth, metric, np.random.default_rng([seed, tree]))
        return pa.table({"tree": pa.array([tree], pa.int32()), "size": pa.array([len(records)], pa.int32()), "node": pa.array([pickle.dumps(node)], pa.binary())})

    grown = sample.groupBy("tree").applyInArrow(grow, "tree int, size int, node binary").orderBy("tree").collect()  # one row a tree
    return ProximityForest(max((r["size"] for r in grown), default=0), [pickle.loads(r["node"]) for r in grown])


def proximity_scores(df: DataFrame, key: str, x: str, forest: ProximityForest, metric: Metric) -> DataFrame:
    """``key``, ``score``: 1 - exp(mean ln(1 - 2^(-h / c))) over the trees; null without
    trees.  Rows whose record is null are left out."""
    kind = df.schema[key].dataType.simpleString()
    c = max(c_factor(forest.psi), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = batch.column(1)
            if forest.trees:
                h = np.mean([np.log1p(-np.minimum(2.0 ** -(depths(t, records, metric) / c), 1 - 1e-12)) for t in forest.trees], axis=0)
                score = pa.array(1 - np.exp(h), pa.float64())
            else:
                score = pa.nulls(len(batch), pa.float64())
            yield pa.record_batch([batch.column(0), score], [key, "score"])

    rows = df.select(key, x).where(F.col(x).isNotNull())
    parts = min(MOST_PARTS, max(1, -(-rows.count() // PART)))
    return rows.repartition(parts).mapInArrow(run, f"`{key}` {kind}, score double")


def record_variances(df: DataFrame, x: str, metric: Metric, candidates: list[Record]) -> list[float | None]:
    """Mean squared distance of all records from each candidate, in one pass: a task
    adds up its own, one row a candidate leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(candidates)), 0
        for batch in batches:
            n += len(batch)
            for i, c in enumerate(candidates):
                total[i] += float((np.asarray(metric(batch.column(0), c), float) ** 2).sum())
        yield pa.record_batch([pa.array(range(len(candidates)), pa.int32()), pa.array(total), pa.array([n] * len(candidates), pa.int64())], ["i", "v", "n"])

    sums = df.select(x).where(F.col(x).isNotNull()).mapInArrow(run, "i int, v double, n long").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    found = {r["i"]: r["v"] / r["n"] if r["n"] else None for r in sums.collect()}  # one row a candidate
    return [found.get(i) for i in range(len(candidates))]


def drawn_candidates(df: DataFrame, key: str, x: str, most: int, seed: int = 1) -> list[Record]:
    """The ``most`` records with the least hashed draws of their key."""
    rows = df.where(F.col(x).isNotNull()).select(uniform(seed, key).alias("u"), F.col(key).alias("k"), x)
    return [r[x].asDict(recursive=True) for r in rows.orderBy("u", "k").limit(most).collect()]


def record_mean(df: DataFrame, x: str, metric: Metric, start: list[Record], oracle: Oracle | None = None, rounds: int = 20, tolerance: float = 1e-9) -> tuple[Record, float] | None:
    """Fréchet's mean of records and its mean squared distance.

    The best of ``start``; then, round by round, the best of what ``oracle`` proposes
    from the best so far and the round's number, until a round gains no more than
    ``tolerance``.  Each round is one pass over the records.  Of equals the first
    proposed; None if there are no records or no candidates.
    """
    best: tuple[Record, float] | None = None
    candidates = start
    for turn in range(rounds + 1):
        values = record_variances(df, x, metric, candidates) if candidates else []
        found = min((v, i) for i, v in enumerate(values)) if values and values[0] is not None else None
        gained = found is not None and (best is None or found[0] < best[1] - tolerance)
        if gained:
            best = candidates[found[1]], found[0]
        if oracle is None or best is None or (turn and not gained):
            break
        candidates = oracle(best[0], turn)
    return best
