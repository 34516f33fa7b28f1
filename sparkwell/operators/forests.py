"""Random forests and single trees over all rows.

All trees grow together, a level at a time.  In each task every row goes down the
trees that are there so far, and the counts and sums of its open nodes are added up
by node, feature and cut; one aggregation by (tree, node, feature, cut) brings the
tasks together, running sums over a node's cuts give the squared error of every split,
and one row a node comes back to the driver.  Rows never move, and each tree sees all
of them, so a single tree uses every task as well as a forest does.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clean

#: Numbers that a task adds up at once; the open nodes of a level are taken in as many jobs.
MOST_CELLS = 4_000_000


def draw(seed: int, *keys: int | str) -> float:
    """What ``functions.expr.uniform`` draws for the keys."""
    text = "|".join(map(str, (seed, *keys)))
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / (1 << 52)


def copies(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson numbers of mean 1, from 64-bit
    hashes of the rows' keys by the splitmix64 step."""
    z = key.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (tree + 1) + 0xD1B54A32D192ED03 * seed) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = (z ^ (z >> np.uint64(31))) / 2.0**64
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)]), u)


@dataclass
class Tree:
    """Nodes in the order in which they grew; ``number`` counts them as in a full tree
    (children of i: 2i+1, 2i+2), ``feature`` is -1 in leaves and -2 for a projection.
    ``sums``: rows, weight, weighted sums of the targets and of their products."""

    number: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    sums: list[list[float]] = field(default_factory=list)

    def add(self, number: int, sums: list[float]) -> int:
        for part, v in ((self.number, number), (self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.sums, sums)):
            part.append(v)
        return len(self.number) - 1


@dataclass
class Forest:
    """``width`` predictors, ``base``: means of the targets, which are taken off them."""

    kind: str
    seed: int
    width: int
    base: list[float]
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def direction(self, tree: int, number: int) -> np.ndarray:
        return np.random.default_rng([self.seed, tree, number]).normal(size=self.width)

    def directions(self, tree: int, nodes: list[int]) -> np.ndarray:
        """One row for each of the tree's nodes, zero but for ``nodes``."""
        out = np.zeros((len(self.trees[tree].number), self.width))
        for n in nodes:
            out[n] = self.direction(tree, self.trees[tree].number[n])
        return out

    def walk(self, tree: int) -> Callable[[np.ndarray], np.ndarray]:
        """Finds the index of the node where each row ends."""
        t = self.trees[tree]
        feature, cut, left, right = (np.array(v) for v in (t.feature, t.cut, t.left, t.right))
        toward = self.directions(tree, np.flatnonzero(feature == -2).tolist()) if self.kind == "projection" else None

        def leaves(x: np.ndarray) -> np.ndarray:
            at = np.zeros(len(x), int)
            rows = np.arange(len(x))
            while True:
                inner = feature[at[rows]] != -1
                if not inner.all():
                    rows = rows[inner]
                if not len(rows):
                    return at
                here = at[rows]
                v = x[rows, feature[here]] if toward is None else _projected(x[rows], toward[here])
                at[rows] = np.where(v <= cut[here], left[here], right[here])

        return leaves

    def values(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and covariances (divisor n, ``targets`` squared) of the targets in each node."""
        s = np.array(self.trees[tree].sums).reshape(len(self.trees[tree].sums), -1)
        q = len(self.base)
        w = np.maximum(s[:, 1:2], 1e-300)
        mean = s[:, 2 : 2 + q] / w
        cov = np.empty((len(s), q, q))
        for k, (i, j) in enumerate(_pairs(q)):
            cov[:, i, j] = cov[:, j, i] = s[:, 2 + q + k] / w[:, 0] - mean[:, i] * mean[:, j]
        return mean + np.array(self.base), cov


def _projected(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Each row along its own direction, added up in the same order everywhere."""
    return np.einsum("ij,ij->i", x, directions)


def _pairs(q: int) -> list[tuple[int, int]]:
    """Pairs of targets whose products are summed, squares first."""
    return [(i, i) for i in range(q)] + [(i, j) for i in range(q) for j in range(i + 1, q)]


def feature_cuts(rows: DataFrame, x: str, width: int, bins: int) -> list[np.ndarray]:
    """Cuts of each predictor: all its values if there are no more than ``bins``, else
    its approximate quantiles.  Each task hands on ``bins`` values of a predictor and one
    more at most."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * width
        for batch in batches:
            data = _matrix(batch.column(0), width)
            for j in range(width):
                if len(seen[j]) <= bins:
                    seen[j] = np.unique(np.concatenate([seen[j], data[:, j]]))[: bins + 1]
        yield pa.record_batch([pa.array(np.repeat(range(width), [len(s) for s in seen]).astype(np.int32)), pa.array(np.concatenate(seen))], ["j", "v"])

    counted = rows.select(x).mapInArrow(some, "j int, v double").distinct()
    few = counted.groupBy("j").agg(F.count("*").alias("n"))
    known = {r["j"]: r["n"] for r in few.collect()}  # one row a predictor
    values: dict[int, list[float]] = {j: [] for j in range(width)}
    small = [j for j, n in known.items() if n <= bins]
    for r in counted.where(F.col("j").isin(small)).collect():  # at most ``bins`` rows a predictor
        values[r["j"]].append(r["v"])
    many = [j for j in range(width) if known.get(j, 0) > bins]
    if many:
        shares = [i / bins for i in range(1, bins)]
        apart = rows.select(*[F.get(x, j).alias(f"c{j}") for j in many])
        for j, q in zip(many, apart.approxQuantile([f"c{j}" for j in many], shares, 0.1 / bins), strict=True):
            values[j] = q
    return [np.unique(values[j]) for j in range(width)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _products(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows of what a node sums: row, weight, targets, products of targets."""
    return np.stack([np.ones(len(w)), w, *(w * v for v in y.T), *(w * y[:, i] * y[:, j] for i, j in _pairs(y.shape[1]))])


def _filled(flat: np.ndarray, sums: np.ndarray, into: np.ndarray) -> None:
    for k in range(len(sums)):
        into[k] += np.bincount(flat, sums[k], minlength=into.shape[1])


Cells = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _batches(batch: pa.RecordBatch, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    key, x, y, w = batch.columns
    return key.to_numpy(), _matrix(x, forest.width), _matrix(y, len(forest.base)) - np.array(forest.base), w.to_numpy()


def _used(node: np.ndarray, sums: np.ndarray, key: np.ndarray, tree: int, forest: Forest, bootstrap: bool) -> tuple[np.ndarray | slice, np.ndarray, np.ndarray]:
    """Rows in open nodes, their nodes, and what they add."""
    c = copies(key, tree, forest.seed) if bootstrap else None
    inside = node >= 0 if c is None else (node >= 0) & (c > 0)
    if c is None and inside.all():
        return slice(None), node, sums
    use = np.flatnonzero(inside)
    return use, node[use], sums[:, use] if c is None else sums[:, use] * c[use]


def _nodes(forest: Forest, nodes: list[tuple[int, int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each tree: for every node its place among ``nodes`` or -1, and those places' nodes."""
    out = {}
    for t in dict(nodes):
        mine = [(i, n) for i, (u, n) in enumerate(nodes) if u == t]
        place = np.full(len(forest.trees[t].number), -1)
        place[[n for _, n in mine]] = range(len(mine))
        out[t] = place, np.array([i for i, _ in mine])
    return out


def _by_cuts(forest: Forest, nodes: list[tuple[int, int]], chosen: list[int] | None, bootstrap: bool) -> Cells:
    """Sums of each open node by predictor (``chosen`` of the node, or every one) and cut."""
    most = max(len(c) for c in forest.cuts) + 1
    held, k = _nodes(forest, nodes), len(forest.base)
    every = range(forest.width) if chosen is None else [None]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {t: np.zeros((2 + k + len(_pairs(k)), len(at) * len(every) * most)) for t, (_, at) in held.items()}
        walks = {t: forest.walk(t) for t in held}
        for batch in batches:
            key, x, y, w = _batches(batch, forest)
            sums = _products(y, w)
            places = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(forest.cuts)], axis=1)
            for t, (place, at) in held.items():
                use, node, adds = _used(place[walks[t](x)], sums, key, t, forest, bootstrap)
                rows = np.arange(len(x))[use]
                for e, j in enumerate(every):
                    f = np.array(chosen)[at[node]] if j is None else j
                    _filled((node * len(every) + e) * most + places[rows, f], adds, total[t])
        for t, (_, at) in held.items():
            cell = np.flatnonzero(total[t][0])
            node, b = at[cell // most // len(every)], cell % most
            f = np.array(chosen)[node] if chosen is not None else cell // most % len(every)
            ends = [np.append(c, math.inf) for c in forest.cuts]
            yield _table(node, f, np.array([ends[i][j] for i, j in zip(f, b, strict=True)]), total[t][:, cell])

    return task


def _by_projections(forest: Forest, nodes: list[tuple[int, int]], ends: np.ndarray, bins: int, bootstrap: bool) -> Cells:
    """Sums of each open node by equal steps of its projection between its ``ends``."""
    held, k = _nodes(forest, nodes), len(forest.base)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {t: np.zeros((2 + k + len(_pairs(k)), len(at) * bins)) for t, (_, at) in held.items()}
        edges = ends[:, :1] + (ends[:, 1:] - ends[:, :1]) * np.arange(1, bins + 1) / bins
        edges[:, -1] = math.inf
        steps = np.maximum(ends[:, 1] - ends[:, 0], 1e-300) / bins
        walks = {t: forest.walk(t) for t in held}
        toward = {t: forest.directions(t, [nodes[i][1] for i in at])[[nodes[i][1] for i in at]] for t, (_, at) in held.items()}
        for batch in batches:
            key, x, y, w = _batches(batch, forest)
            sums = _products(y, w)
            for t, (place, at) in held.items():
                use, node, adds = _used(place[walks[t](x)], sums, key, t, forest, bootstrap)
                v, i = _projected(x[use], toward[t][node]), at[node]
                b = np.clip((v - ends[i, 0]) / steps[i], 0, bins - 1).astype(int)
                # the edges decide, as they do when rows are split
                b += v > edges[i, b]
                b -= (b > 0) & (v <= edges[i, np.maximum(b - 1, 0)])
                _filled(node * bins + b, adds, total[t])
        for t, (_, at) in held.items():
            cell = np.flatnonzero(total[t][0])
            node = at[cell // bins]
            yield _table(node, np.full(len(cell), -2), edges[node, cell % bins], total[t][:, cell])

    return task


def _ranges(forest: Forest, nodes: list[tuple[int, int]]) -> Cells:
    """Least and greatest projection of each open node."""
    held = _nodes(forest, nodes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(len(nodes), math.inf), np.full(len(nodes), -math.inf)
        walks = {t: forest.walk(t) for t in held}
        toward = {t: forest.directions(t, [nodes[i][1] for i in at])[[nodes[i][1] for i in at]] for t, (_, at) in held.items()}
        for batch in batches:
            x = _matrix(batch.column(1), forest.width)
            for t, (place, at) in held.items():
                node = place[walks[t](x)]
                use = np.flatnonzero(node >= 0)
                v = _projected(x[use], toward[t][node[use]])
                np.minimum.at(low, at[node[use]], v)
                np.maximum.at(high, at[node[use]], v)
        seen = np.flatnonzero(low <= high)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(low[seen]), pa.array(high[seen])], ["node", "low", "high"])

    return task


def _table(node: np.ndarray, f: np.ndarray, cut: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    names = ["node", "feature", "cut", *(f"s{k}" for k in range(len(sums)))]
    return pa.record_batch([pa.array(np.asarray(node, np.int32)), pa.array(np.asarray(f, np.int32)), pa.array(np.asarray(cut, float)), *(pa.array(s) for s in sums)], names)


def _splits(cells: DataFrame, forest: Forest, least: int) -> DataFrame:
    """``node``, ``all`` (its sums) and the best split that leaves ``least`` rows on
    both sides, as ``best`` (``score``, ``feature``, ``cut``, ``low``: sums of the left side).

    ``random``: the least squared error among cuts nearest below places between the first
    and the last cut, at the shares ``u`` of the node; ``best``: among all; ``projection``: the
    cut whose rank is nearest to the first of ``u``, -1 to 1 about the middle.
    """
    q = len(forest.base)
    width = 2 + q + len(_pairs(q))
    names = [f"s{k}" for k in range(width)]
    order = Window.partitionBy("node", "feature").orderBy("cut")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("node", "feature")
    run = cells.select("node", "feature", "cut", "u", *[F.sum(c).over(upto).alias(f"l{k}") for k, c in enumerate(names)], *[F.sum(c).over(whole).alias(f"t{k}") for k, c in enumerate(names)], F.lead("cut").over(order).alias("following"))
    low, high = F.col("l0") >= least, F.col("t0") - F.col("l0") >= least
    run = run.withColumn("fits", low & high)
    error = F.lit(0.0)
    for side in (lambda k: F.col(f"l{k}"), lambda k: F.col(f"t{k}") - F.col(f"l{k}")):
        for i in range(q):
            error = error + side(2 + q + i) - side(2 + i) * side(2 + i) / F.nullif(side(1), F.lit(0.0))
    if forest.kind == "random":
        a, b = (f(F.when(F.col("fits"), F.col("cut"))).over(whole) for f in (F.min, F.max))
        run = run.withColumns({"a": a, "b": b})
        near = F.exists("u", lambda u: (F.col("cut") <= F.col("a") + (F.col("b") - F.col("a")) * u) & (F.col("following") > F.col("a") + (F.col("b") - F.col("a")) * u))
        run = run.withColumn("fits", F.col("fits") & near)
    elif forest.kind == "projection":
        error = F.abs(F.col("l0") - F.col("t0") / 2 - (F.col("t0") - 2 * least) / 2 * F.get("u", 0))
    split = F.struct(error.alias("score"), "feature", "cut", F.array(*[f"l{k}" for k in range(width)]).alias("low"))
    totals = F.struct("feature", F.array(*[f"t{k}" for k in range(width)]).alias("t"))
    return run.groupBy("node").agg(F.min(totals)["t"].alias("all"), F.min(F.when(F.col("fits"), split)).alias("best"))


def grow_forest(
    df: DataFrame, key: str, x: str, y: list[str], trees: int = 20, depth: int = 8, least: int = 5, kind: str = "random", seed: int = 1, bins: int = 64, tests: int = 10, weight: str | None = None, bootstrap: bool = False,
) -> Forest:
    """A forest of ``trees`` trees for the targets ``y`` on the array ``x``, over all rows.

    ``kind``: ``random`` (a random predictor a node; the best of ``tests`` random cuts and
    the middle), ``best`` (the best cut of all predictors) or ``projection`` (a random
    direction, cut at a random rank that is nearer the middle than the ends).  Predictors
    are cut at each of their values if they have no more than ``bins``, else at as many
    quantiles; projections at equal steps.  ``bootstrap``: rows count as often as Poisson
    draws by their ``key`` and the tree say, else once.  ``weight``: a case weight.
    Errors of several targets are added.

    Rows with a null or NaN in a predictor, a target or the weight are left out, and
    vectors of another length than the first; nodes with fewer than two times ``least``
    rows are leaves.  No rows give a forest without trees.  A level costs one job (two for
    projections) for each ``MOST_CELLS`` numbers that a task has to hold.
    """
    if kind not in ("random", "best", "projection"):
        raise ValueError(f"no forest of kind {kind}")
    w = clean(weight) if weight else F.lit(1.0)
    rows = df.select(F.xxhash64(key).alias("key"), F.col(x).cast("array<double>").alias("x"), F.array(*[clean(c) for c in y]).alias("y"), w.alias("w"))
    good = lambda c: F.col(c).isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))
    rows = rows.where(good("x") & good("y") & F.col("w").isNotNull())
    first = rows.select(F.size("x").alias("n")).first()
    forest = Forest(kind, seed, first["n"] if first else 0, [0.0] * len(y), [])
    if first is None or not forest.width:
        return forest
    rows = rows.where(F.size("x") == forest.width)
    forest.base = list(rows.agg(*[F.avg(F.get("y", i)) for i in range(len(y))]).first())
    if kind != "projection":
        forest.cuts = feature_cuts(rows, "x", forest.width, bins)
    forest.trees = [Tree() for _ in range(trees)]
    for t in forest.trees:
        t.add(0, [0.0] * (2 + len(y) + len(_pairs(len(y)))))
    open_nodes = [(t, 0) for t in range(trees)]
    each = bins if kind == "projection" else (max(map(len, forest.cuts)) + 1) * (forest.width if kind == "best" else 1)
    block = max(1, MOST_CELLS // (each * len(forest.trees[0].sums[0])))
    for level in range(depth):
        following: list[tuple[int, int]] = []
        for at in range(0, len(open_nodes), block):
            following += _grown(rows, forest, open_nodes[at : at + block], level, least, bins, tests, bootstrap)
        open_nodes = following
        if not open_nodes:
            break
    return forest


def _drawn(forest: Forest, tests: int, tree: int, number: int) -> list[float]:
    """Where a node tries to cut."""
    if forest.kind == "projection":
        return [draw(forest.seed, "a", tree, number) - draw(forest.seed, "b", tree, number)]
    return [0.5, *(draw(forest.seed, k, tree, number) for k in range(tests))] if forest.kind == "random" else []


def _grown(rows: DataFrame, forest: Forest, nodes: list[tuple[int, int]], level: int, least: int, bins: int, tests: int, bootstrap: bool) -> list[tuple[int, int]]:
    """Split ``nodes`` (tree, index); the new nodes that are large enough to split."""
    numbers = [(t, forest.trees[t].number[n]) for t, n in nodes]
    width = len(forest.trees[0].sums[0])
    shape = "node int, feature int, cut double, " + ", ".join(f"s{k} double" for k in range(width))
    if forest.kind == "projection":
        found = rows.mapInArrow(_ranges(forest, nodes), "node int, low double, high double").groupBy("node").agg(F.min("low"), F.max("high")).collect()
        ends = np.zeros((len(nodes), 2))
        for i, low, high in found:
            ends[i] = low, high
        cells = rows.mapInArrow(_by_projections(forest, nodes, ends, bins, bootstrap), shape)
    else:
        chosen = [int(draw(forest.seed, "f", *n) * forest.width) for n in numbers] if forest.kind == "random" else None
        cells = rows.mapInArrow(_by_cuts(forest, nodes, chosen, bootstrap), shape)
    cells = cells.groupBy("node", "feature", "cut").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)])
    session = rows.sparkSession
    drawn = session.createDataFrame([(i, _drawn(forest, tests, *n)) for i, n in enumerate(numbers)], "node int, u array<double>")
    cells = cells.join(F.broadcast(drawn), "node")  # one row an open node of the block
    following = []
    for i, total, best in sorted(_splits(cells, forest, least).collect(), key=lambda r: r[0]):  # one row a node
        t, n = nodes[i]
        tree = forest.trees[t]
        if level == 0:
            tree.sums[n] = total
        if best is None:
            continue
        tree.feature[n], tree.cut[n] = best["feature"], best["cut"]
        sides = best["low"], [a - b for a, b in zip(total, best["low"], strict=True)]
        tree.left[n], tree.right[n] = (tree.add(2 * tree.number[n] + 1 + k, s) for k, s in enumerate(sides))
        following += [(t, c) for c, s in zip((tree.left[n], tree.right[n]), sides, strict=True) if s[0] >= 2 * least]
    return following


def forest_predict(df: DataFrame, key: str, x: str, forest: Forest, targets: list[str], weighting: str = "variance") -> DataFrame:
    """``key`` and for each target its prediction and standard error, where rows lie.
    Trees weigh 1 / sqrt(greatest variance of their leaf) (``variance``), one over that
    variance (``precision``), 1 / determinant of the leaf's covariance matrix
    (``determinant``) or the same (``equal``).  Rows without a vector of the forest's
    length are left out; a vector with a null goes right at its cuts; without trees
    all predictions are null."""
    kind = df.schema[key].dataType.simpleString()
    q = len(targets)
    columns = ", ".join(f"`{t}` double, `{t}_se` double" for t in targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = [(*forest.values(t), forest.walk(t)) for t in range(len(forest.trees))]
        for batch in batches:
            data = _matrix(batch.column(1), forest.width) if forest.width else np.zeros((len(batch), 0))
            n = len(data)
            total, norm, var = np.zeros((n, q)), np.zeros((n, 1)), np.zeros((n, q))
            for mean, cov, walk in nodes:
                leaf = walk(data)
                s = np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0.0)
                w = {
                    "variance": lambda s=s, cov=cov: 1 / np.sqrt(s.max(1) + 1e-9),
                    "precision": lambda s=s, cov=cov: 1 / (s.max(1) + 1e-9),
                    "determinant": lambda s=s, cov=cov: 1 / np.maximum(np.linalg.det(cov + 1e-3 * np.eye(q)), 1e-300),
                    "equal": lambda s=s, cov=cov: np.ones(len(s)),
                }[weighting]()[leaf][:, None]
                total, norm, var = total + w * mean[leaf], norm + w, var + w * w * s[leaf]
            out = [batch.column(0)]
            with np.errstate(invalid="ignore", divide="ignore"):
                for j in range(q):
                    out += [pa.array(v, pa.float64(), from_pandas=True) for v in (total[:, j] / norm[:, 0], np.sqrt(var[:, j]) / norm[:, 0])]
            yield pa.record_batch(out, [key, *(f"{t}{e}" for t in targets for e in ("", "_se"))])

    usable = df.select(key, F.col(x).cast("array<double>").alias("x")).where(F.col("x").isNotNull())
    if forest.width:
        usable = usable.where(F.size("x") == forest.width)
    return usable.mapInArrow(run, f"`{key}` {kind}, {columns}")
