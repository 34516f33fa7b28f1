from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwell.operators import records
from sparkwell.operators.iforest import c_factor
from sparkwell.plans import catalogue

SCHEMA = "id long, x struct<size: double, name: string>"


def metric(x, p):
    """Difference in size, and in how often each letter comes."""
    size = np.abs(x.field("size").to_numpy(zero_copy_only=False) - p["size"])
    names = [sum(abs(n.count(c) - p["name"].count(c)) for c in {*n, *p["name"]}) for n in x.field("name").to_pylist()]
    return size + np.array(names, float)


def plain(a, b):
    return float(metric(pa.array([a], pa.struct([("size", pa.float64()), ("name", pa.string())])), b)[0])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, (float(rng.integers(0, 5)), "".join(rng.choice(list("abc"), 3)))) for i in range(200)] + [(900, (80.0, "zzzzzzzzzz"))]
    return spark.createDataFrame([*data, (901, None)], SCHEMA).repartition(3), [(i, {"size": s, "name": n}) for i, (s, n) in data]


def depth(node, r, k=0):
    if not node.prototypes:
        return k + c_factor(node.size)
    d = [plain(r, p) for p in node.prototypes]
    if len(d) == 2:
        g = plain(*node.prototypes)
        d = [2 * g / (g + d[0] + d[1])]
    return depth(node.left if d[0] <= node.threshold else node.right, r, k + 1)


@pytest.mark.parametrize("kind", ["one", "two"])
def test_scores_equal_a_walk_record_by_record(rows, kind):
    df, data = rows
    forest = records.proximity_forest(df, "id", "x", metric, 15, 16, kind)
    assert len(forest.trees) == 15 and forest.psi == 16
    got = {r["id"]: r["score"] for r in records.proximity_scores(df, "id", "x", forest, metric).collect()}
    c = c_factor(16)
    for i, r in data:
        h = [math.log1p(-min(2 ** (-depth(t, r) / c), 1 - 1e-12)) for t in forest.trees]
        assert got[i] == pytest.approx(1 - math.exp(sum(h) / 15))
    assert got.keys() == {i for i, _ in data} and max(got, key=got.get) == 900


@pytest.mark.parametrize("kind", ["one", "two"])
def test_a_tree_equals_one_grown_from_its_sample(rows, kind):
    """Grown again from the drawn records by plain recursion."""
    df, _ = rows
    forest = records.proximity_forest(df, "id", "x", metric, 4, 16, kind, seed=5)
    drawn = records._drawn(df.where("x IS NOT NULL"), "id", "x", 4, 16, 5).orderBy("tree", "i").collect()

    def grow(sample, limit, rng):
        if len(sample) <= 1 or limit == 0:
            return len(sample)
        p = [sample[int(i)] for i in rng.choice(len(sample), 1 if kind == "one" else 2, replace=False)]
        v = [plain(r, p[0]) for r in sample]
        if kind == "two":
            g = plain(p[0], p[1])
            v = [2 * g / max(g + a + plain(r, p[1]), 1e-300) for a, r in zip(v, sample, strict=True)]
        if min(v) == max(v):
            return len(sample)
        cut = min(v) + rng.random() * (max(v) - min(v)) if kind == "one" else 0.5 if min(v) <= 0.5 < max(v) else (min(v) + max(v)) / 2
        sides = [[r for r, a in zip(sample, v, strict=True) if (a <= cut) == left] for left in (True, False)]
        return (p, pytest.approx(cut), *(grow(s, limit - 1, rng) for s in sides))

    def shape(n):
        return (list(n.prototypes), n.threshold, shape(n.left), shape(n.right)) if n.prototypes else n.size

    for t in range(4):
        sample = [r["x"].asDict() for r in drawn if r["tree"] == t]
        assert len(sample) == 16
        assert shape(forest.trees[t]) == grow(sample, 4, np.random.default_rng([5, t]))


def test_mean_of_records(rows):
    df, data = rows
    every = [{"size": float(s), "name": n} for s in range(5) for n in ("abc", "aab", "bcc", "abb", "")]
    got, value = records.record_mean(df, "x", metric, every)
    want = [sum(plain(r, c) ** 2 for _, r in data) / len(data) for c in every]
    assert value == pytest.approx(min(want)) and got == every[int(np.argmin(want))]
    # an oracle that tries the neighbours of the best finds the same from afar
    near = lambda best, turn: [{"size": best["size"] + d, "name": n} for d in (-1, 0, 1) for n in {best["name"], "abc", "abb", "aab", "bcc", ""}]
    assert records.record_mean(df, "x", metric, [{"size": 9.0, "name": "cc"}], near)[1] <= min(want) + 1e-9


def test_edges(spark, rows):
    none = spark.createDataFrame([(1, None)], SCHEMA)
    forest = records.proximity_forest(none, "id", "x", metric, 3, 4)
    assert forest.trees == [] and records.proximity_scores(none, "id", "x", forest, metric).count() == 0
    assert [r["score"] for r in records.proximity_scores(rows[0].limit(1), "id", "x", forest, metric).collect()] in ([None], [])
    assert records.record_mean(none, "x", metric, [{"size": 0.0, "name": ""}]) is None
    assert records.record_mean(rows[0], "x", metric, []) is None
    same = spark.createDataFrame([(i, (1.0, "a")) for i in range(9)], SCHEMA)
    forest = records.proximity_forest(same, "id", "x", metric, 3, 4)
    assert [t.size for t in forest.trees] == [4, 4, 4]
    assert len(records.drawn_candidates(rows[0], "id", "x", 5)) == 5


def test_few_rows_of_many_are_offered(spark):
    df = spark.range(20_000).select("id", F.struct(F.col("id").cast("double").alias("size"), F.lit("a").alias("name")).alias("x"))
    drawn = records._drawn(df, "id", "x", 10, 16, 1).groupBy("tree").count().collect()
    assert sorted(r["count"] for r in drawn) == [16] * 10


def test_scores_of_a_small_file_are_dealt_out(spark, monkeypatch):
    """Tasks by rows, not by bytes; the same scores however they are dealt."""
    df = spark.range(0, 90, 1, 1).select("id", F.struct((F.col("id") % 7).cast("int").alias("size"), F.concat(F.lit("b"), F.col("id") % 3).alias("brand")).alias("x"))
    forest = records.proximity_forest(df, "id", "x", catalogue._part_metric, 5, 20, "two", 4)
    whole = {r["id"]: r["score"] for r in records.proximity_scores(df, "id", "x", forest, catalogue._part_metric).collect()}
    monkeypatch.setattr(records, "PART", 20, raising=False)
    dealt = records.proximity_scores(df, "id", "x", forest, catalogue._part_metric)
    assert dealt.rdd.getNumPartitions() == 5
    assert {r["id"]: r["score"] for r in dealt.collect()} == whole and len(whole) == 90


def test_part_metric_of_nulls():
    x = pa.array([{"size": 10, "brand": "a"}, {"size": 20, "brand": None}, {"size": 30, "brand": "b"}])
    assert list(catalogue._part_metric(x, {"size": 10, "brand": "a"})) == pytest.approx([0.0, 1.2, 1.4])
    assert list(catalogue._part_metric(x, {"size": 20, "brand": None})) == pytest.approx([1.2, 0.0, 1.2])
