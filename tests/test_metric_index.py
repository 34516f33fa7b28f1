from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell.functions import distances
from sparkwell.operators import metric_index as mi


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 6)) * 4
    x = centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 6)) * 0.5
    x[200:700] = x[200]  # a third are copies of one vector
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>").repartition(5), x


def truth(x, queries, k, norm):
    out = {}
    for q in queries:
        d = norm(x - x[q])
        order = sorted(range(len(x)), key=lambda i: (round(float(d[i]), 9), i))[:k]
        out[q] = [(i, float(d[i])) for i in order]
    return out


def taken(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r["id"], r["distance"]))
    return out


@pytest.mark.parametrize(("metric", "norm"), [(distances.euclidean, lambda d: np.sqrt((d**2).sum(1))), (distances.manhattan, lambda d: np.abs(d).sum(1))])
def test_exact_search_equals_all_pairs(points, metric, norm):
    df, x = points
    index = mi.build_index(df, metric, branch=4, leaf=40, most=10)
    assert index.levels >= 3
    queries = df.where("id % 25 = 0").select(F.col("id").alias("query"), F.col("x").alias("q"))
    got = taken(mi.nearest_indexed(index, queries, 7, metric))
    want = truth(x, range(0, 1500, 25), 7, norm)
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in rows]
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in rows])
    work = mi.search_work(index, queries, 7, metric).first()
    assert work["share"] < 0.6 and work["computed"] > 0


def test_probes_have_recall(points):
    df, _ = points
    index = mi.build_index(df, distances.euclidean, branch=4, leaf=40, most=10)
    queries = df.where("id % 25 = 0").select(F.col("id").alias("query"), F.col("x").alias("q"))
    exact = mi.nearest_indexed(index, queries, 5, distances.euclidean)
    found = mi.nearest_indexed(index, queries, 5, distances.euclidean, probe=5)
    assert mi.recall(found, exact).first()[0] > 0.9
    assert mi.search_work(index, queries, 5, distances.euclidean, 5).first()["share"] < 0.4


def test_index_is_a_tree_of_balls(points):
    df, x = points
    index = mi.build_index(df, distances.euclidean, branch=4, leaf=40, most=10)
    kept = [r["id"] for r in index.rows.collect()]
    assert sorted(kept) == [*range(210), *range(700, 1500)]  # of the copies the first ten
    leaves = {c["node"]: c for r in index.nodes[-1].collect() for c in r["children"]}
    for r in index.rows.collect():
        c = leaves[r["node"]]
        assert r["away"] == pytest.approx(float(np.linalg.norm(x[r["id"]] - np.array(c["x"])))) and r["away"] <= c["radius"]
    assert sum(c["n"] for c in leaves.values()) == len(kept)
    assert max(len(r["children"]) for level in index.nodes for r in level.collect()) <= 4


def test_edges(spark):
    schema = "id long, x array<double>"
    index = mi.build_index(spark.createDataFrame([], schema), distances.euclidean)
    ask = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0])], "query long, q array<double>")
    assert mi.nearest_indexed(index, ask, 2, distances.euclidean).count() == 0
    odd = spark.createDataFrame([(5, [0.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [None, 0.0]), (8, [float("nan"), 0.0])], schema)
    index = mi.build_index(odd, distances.euclidean, most=3)
    assert taken(mi.nearest_indexed(index, ask, 3, distances.euclidean)) == {1: [(5, pytest.approx(2**0.5))] * 2}
    with pytest.raises(ValueError):
        mi.nearest_indexed(index, ask, 4, distances.euclidean)


def test_pieces_meet_blocks_of_queries(spark, points, monkeypatch):
    """No pair of vectors is a row of a join; pieces and blocks smaller than a leaf's share, ids
    as text, infinite queries and queries of another length keep the rows."""
    monkeypatch.setattr(mi, "PIECE", 50)
    monkeypatch.setattr(mi.blocks, "BLOCK", 100)
    df, _ = points
    named = df.select(F.format_string("%05d", "id").alias("id"), "x")
    queries = named.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("x").alias("q"))
    odd = spark.createDataFrame([("inf", [float("inf")] + [0.0] * 5), ("short", [0.0])], "query string, q array<double>")
    queries = queries.unionByName(odd)
    index = mi.build_index(named, distances.euclidean, branch=4, leaf=40, most=10)
    found = mi.nearest_indexed(index, queries, 7, distances.euclidean)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
    plain = mi.build_index(named, lambda a, b: distances.euclidean(a, b), branch=4, leaf=40, most=10)
    assert index.pieces is not None and plain.pieces is None
    for probe in (None, 5):
        got, want = (taken(mi.nearest_indexed(i, queries, 7, m, probe)) for i, m in ((index, distances.euclidean), (plain, lambda a, b: distances.euclidean(a, b))))
        assert got.keys() == want.keys() and "inf" in got and "short" not in got
        assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in got)
