from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell.operators import forests

LEAST = 5


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 12, 500), rng.integers(0, 7, 500), rng.normal(size=500).round(1)])
    y = np.column_stack([2.0 * x[:, 0] + rng.normal(size=500), (x[:, 1] > 3) * 5 + x[:, 2]])
    w = rng.integers(1, 4, 500).astype(float)
    data = [(i, [float(v) for v in a], float(b), float(c), float(d)) for i, (a, (b, c), d) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(data, "id long, x array<double>, y double, z double, w double").repartition(5), x, y, w


def brute(x, y, w, c, depth, kind, tree, number, forest):
    """A tree by recursion over all cuts of a node's rows; the leaf number of each row."""
    where = np.full(len(x), number)
    if depth == 0 or c.sum() < 2 * LEAST:
        return where
    features = range(x.shape[1]) if kind == "best" else [int(forests.draw(1, "f", tree, number) * x.shape[1])]
    best = None
    for f in features:
        every = np.unique(x[c > 0, f])
        cuts = [v for v in every if c[x[:, f] <= v].sum() >= LEAST and c[x[:, f] > v].sum() >= LEAST]
        if kind == "random" and cuts:
            us = [0.5, *(forests.draw(1, k, tree, number) for k in range(10))]
            cuts = sorted({every[every <= cuts[0] + (cuts[-1] - cuts[0]) * u].max() for u in us} & {*cuts})
        for v in cuts:
            error = 0.0
            for side in (x[:, f] <= v, x[:, f] > v):
                k = (w * c)[side][:, None]
                error += (k * (y[side] - (k * y[side]).sum(0) / k.sum()) ** 2).sum()
            if best is None or error < best[0] - 1e-9:
                best = error, f, v
    if best is None:
        return where
    left = x[:, best[1]] <= best[2]
    for side, child in ((left, 2 * number + 1), (~left, 2 * number + 2)):
        where[side] = brute(x[side], y[side], w[side], c[side], depth - 1, kind, tree, child, forest)
    return where


@pytest.mark.parametrize("kind", ["random", "best"])
@pytest.mark.parametrize("bootstrap", [False, True])
def test_same_trees_as_by_recursion(rows, spark, kind, bootstrap):
    df, x, y, w = rows
    forest = forests.grow_forest(df, "id", "x", ["y", "z"], 4, 3, LEAST, kind, weight="w", bootstrap=bootstrap)
    key = np.array([r[0] for r in spark.range(500).select(F.xxhash64("id")).collect()])
    for t, tree in enumerate(forest.trees):
        c = forests.copies(key, t, 1) if bootstrap else np.ones(500)
        want = brute(x, y, w, c, 3, kind, t, 0, forest)
        at = forest.walk(t)(x)
        assert (np.array(tree.number)[at] == want).all()
        mean, cov = forest.values(t)
        for leaf in np.unique(at):
            k = (w * c)[at == leaf][:, None]
            m = (k * y[at == leaf]).sum(0) / k.sum()
            assert np.allclose(mean[leaf], m)
            assert np.allclose(cov[leaf], ((y[at == leaf] - m) * k).T @ (y[at == leaf] - m) / k.sum(), atol=1e-8)
            assert tree.sums[leaf][0] == c[at == leaf].sum()


def test_blocks_of_nodes_give_the_same_trees(rows, monkeypatch):
    df = rows[0]
    grow = lambda: forests.grow_forest(df, "id", "x", ["y"], 3, 4, LEAST, "random")
    one = grow()
    monkeypatch.setattr(forests, "MOST_CELLS", 1)
    shape = lambda f: [sorted(zip(t.number, t.feature, t.cut, strict=True)) for t in f.trees]
    assert shape(grow()) == shape(one)


def test_projections(rows):
    df, x, y, _ = rows
    forest = forests.grow_forest(df, "id", "x", ["y"], 6, 5, LEAST, "projection")
    for t, tree in enumerate(forest.trees):
        at = forest.walk(t)(x)
        inner = [i for i, f in enumerate(tree.feature) if f == -2]
        assert len(inner) > 5 and tree.sums[0][0] == 500
        # sizes that were summed are those of the rows that arrive, none too small
        for leaf, n in zip(*np.unique(at, return_counts=True), strict=True):
            assert tree.sums[leaf][0] == n >= LEAST
        v = x @ forest.direction(t, 0)
        tri = forests.draw(1, "a", t, 0) - forests.draw(1, "b", t, 0)
        assert abs((v <= tree.cut[0]).sum() - (250 + tri * (500 - 2 * LEAST) / 2)) < 40  # a step of 64
    p = forests.forest_predict(df, "id", "x", forest, ["p"], "precision").join(df, "id")
    assert p.select(F.corr("p", "y")).first()[0] > 0.8


@pytest.mark.parametrize("weighting", ["variance", "precision", "determinant", "equal"])
def test_predictions_by_hand(rows, weighting):
    df, x, _, _ = rows
    forest = forests.grow_forest(df, "id", "x", ["y", "z"], 3, 2, LEAST, "random")
    total = norm = 0
    for t in range(3):
        mean, cov = forest.values(t)
        at = forest.walk(t)(x)
        s = np.array([max(c[0, 0], c[1, 1]) for c in cov])
        k = {"variance": 1 / np.sqrt(s + 1e-9), "precision": 1 / (s + 1e-9), "determinant": 1 / np.linalg.det(cov + 1e-3 * np.eye(2)), "equal": np.ones(len(s))}[weighting][at][:, None]
        total, norm = total + k * mean[at], norm + k
    got = {r["id"]: (r["a"], r["b"]) for r in forests.forest_predict(df, "id", "x", forest, ["a", "b"], weighting).collect()}
    assert np.allclose([got[i] for i in range(500)], total / norm)


def test_edges(spark, rows):
    schema = "id long, x array<double>, y double"
    none = forests.grow_forest(spark.createDataFrame([], schema), "id", "x", ["y"], 3)
    assert none.trees == []
    odd = spark.createDataFrame([(1, [1.0], 2.0), (2, None, 1.0), (3, [None], 1.0), (4, [float("nan")], 1.0), (5, [1.0], None), (6, [2.0], float("nan")), (7, [3.0], 4.0), (7, [3.0], 4.0)], schema)
    few = forests.grow_forest(odd, "id", "x", ["y"], 2, 3, 5, "best")
    assert [t.sums[0][0] for t in few.trees] == [3, 3] and {r["p"] for r in forests.forest_predict(odd.where("id in (1, 7)"), "id", "x", few, ["p"]).collect()} == {10 / 3}
    assert [r["p"] for r in forests.forest_predict(odd.where("id = 1"), "id", "x", none, ["p"]).collect()] == [None]
    same = spark.createDataFrame([(i, [1.0, 1.0], 1.0) for i in range(30)], schema)
    assert [len(t.number) for t in forests.grow_forest(same, "id", "x", ["y"], 2, 3, 5, "random").trees] == [1, 1]
    many = forests.grow_forest(rows[0], "id", "x", ["y"], 1, 2, 5, "best", bins=6)
    assert max(map(len, many.cuts)) <= 7 and len(many.trees[0].number) == 7
    with pytest.raises(ValueError):
        forests.grow_forest(same, "id", "x", ["y"], kind="oak")


def test_copies_are_poisson_numbers():
    c = forests.copies(np.arange(200_000) * 7919, 3, 1)
    assert abs(c.mean() - 1) < 0.02 and abs(c.var() - 1) < 0.03
    assert abs(np.corrcoef(c, forests.copies(np.arange(200_000) * 7919, 4, 1))[0, 1]) < 0.01
