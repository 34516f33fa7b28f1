"""Distances by blocks equal those of the column expressions, odd vectors included."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwell.functions import block_distances, distances
from sparkwell.operators import blocks, neighbors
from sparkwell.plans import catalogue

NAN = float("nan")


def _close(a, b):
    return a == b or (a is not None and b is not None and (abs(a - b) < 1e-9 or (np.isnan(a) and np.isnan(b))))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(rng.normal(size=(70, 4)))]
    rows[9] = (9, rows[8][1])
    rows += [(70, [0.0, 0.0, 0.0, 0.0]), (71, [1.0, None, 2.0, 3.0]), (72, [1.0, 2.0]), (73, None), (74, [NAN, 1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    return spark.createDataFrame(rows, "id long, x array<double>").repartition(3)


METRICS = {
    "euclidean": distances.euclidean, "manhattan": distances.manhattan, "chebyshev": distances.chebyshev, "chebyshev_reference": lambda x, y: distances.chebyshev(x, y, "reference"),
    "minkowski": lambda x, y: distances.minkowski(x, y, 3), "canberra": distances.canberra, "bray_curtis": distances.bray_curtis, "clark": distances.clark, "soergel": distances.soergel,
    "hassanat": distances.hassanat, "cosine": distances.cosine, "pearson": distances.pearson, "fuzzy_hamming": distances.fuzzy_hamming, "vector_dot": distances.dot,
}


@pytest.mark.parametrize("name", METRICS)
def test_blocks_equal_columns(spark, vectors, name, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 40)  # several blocks
    queries = vectors.where("id IS NULL OR id % 10 IN (0, 1)").select(F.col("id").alias("query"), F.col("x").alias("q"))
    got = neighbors.pair_values(queries, vectors, "id", METRICS[name], catalogue._BLOCK_VALUES[name])
    want = neighbors.pairs(queries, vectors).select("id", "query", METRICS[name](F.col("x"), F.col("q")).alias("value"))
    got, want = ({(r["id"], r["query"]): r["value"] for r in df.collect()} for df in (got, want))
    assert len(got) == 76 * 17 and got.keys() == want.keys()
    assert not [(k, got[k], want[k]) for k in got if not _close(got[k], want[k])]


def test_pairs_are_met_in_blocks(spark):
    """A join of blocks, with no array loop on a pair."""
    plan = catalogue.QUERIES["distance_manhattan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_nearest_by_blocks(spark, vectors, monkeypatch):
    """Equal distances go by id, over blocks and with columns kept."""
    monkeypatch.setattr(blocks, "BLOCK", 40)
    rows = vectors.withColumn("y", F.col("id") * 2).where("id IS NOT NULL")
    queries = rows.where("id < 74 AND id % 8 = 0").select(F.col("id").alias("query"), F.col("x").alias("q"))
    got = {(r["query"], r["rank"]): (r["id"], r["y"], r["distance"]) for r in neighbors.nearest(queries, rows, 3, distances.euclidean, ["y"]).collect()}
    # a function of its own is not known to the blocks
    plain = neighbors.nearest(queries, rows, 3, lambda x, q: distances.euclidean(x, q), ["y"])
    want = {(r["query"], r["rank"]): (r["id"], r["y"], r["distance"]) for r in plain.collect()}
    assert got.keys() == want.keys() and got[(8, 1)][0] == 8 and got[(8, 2)][0] == 9
    assert all(got[k][:2] == want[k][:2] and _close(got[k][2], want[k][2]) for k in got)
    assert neighbors.nearest(queries, rows.limit(0), 3, distances.euclidean).count() == 0
    copies = spark.range(300).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    one = neighbors.nearest(copies.where("id = 5").select(F.col("id").alias("query"), F.col("x").alias("q")), copies, 4, distances.manhattan)
    assert [r["id"] for r in one.orderBy("rank").collect()] == [0, 1, 2, 3]


def test_smoothers_form_a_pair_once_for_copies(spark):
    """Copies of rows and queries are added up before pairs are formed."""
    from sparkwell.functions import kernels

    asked = []

    def kernel(u):
        asked.append(u)
        return kernels.epanechnikov(u)

    rows = spark.range(4000).select(F.pmod("id", F.lit(40)).cast("double").alias("x"), F.pmod("id", F.lit(7)).cast("double").alias("y"))
    queries = spark.range(600).select(F.col("id").alias("query"), (F.pmod("id", F.lit(30)) + 0.5).alias("q"))
    pairs = neighbors.near_pairs(neighbors._different(queries), rows.groupBy("x").agg(F.count("*").alias("n")), 2.0, F.col("x"), F.col("q"))
    assert pairs.count() == 4 * 30 - 1 and {r["n"] for r in pairs.collect()} == {100}
    line = {r["query"]: r["prediction"] for r in neighbors.local_linear(queries, rows, kernel, 2.0, compact=True).collect()}
    mean = neighbors.local_average(queries.withColumn("q", F.array("q")), rows.withColumn("x", F.array("x")), kernel, 2.0, compact=True)
    mean = {r["query"]: r["prediction"] for r in mean.collect()}
    assert len(line) == len(mean) == 600 and asked
    for q in (0, 29, 31, 599):
        at = q % 30 + 0.5
        got = [(i % 40, i % 7) for i in range(4000) if abs(i % 40 - at) < 2]
        k = [0.75 * (1 - ((x - at) / 2) ** 2) for x, _ in got]
        assert mean[q] == pytest.approx(sum(w * y for w, (_, y) in zip(k, got, strict=True)) / sum(k))


@pytest.mark.parametrize("name", ["canberra", "chebyshev_reference", "clark", "euclidean", "fuzzy_hamming", "hassanat", "minkowski", "soergel", "vector_dot"])
def test_blocks_are_worked_out_in_place(name):
    """A coordinate makes no arrays of pairs of its own: the result, two buffers, and what
    ends the distance."""
    import tracemalloc

    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(64, 8)), rng.normal(size=(512, 8))
    metric = catalogue._BLOCK_VALUES[name]
    metric(x, q)
    tracemalloc.start()
    metric(x, q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4.7 * 64 * 512 * 8


def _vectors_of(kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return {
        "unit": (x, x[::4]),
        "copies": (np.repeat(x[:20], 10, 0), x[:20]),
        "near": (x + rng.normal(size=x.shape) * 1e-7, x[:50]),
        "zero": (np.vstack([np.zeros((3, 8)), x]), np.vstack([np.zeros((2, 8)), x[:50]])),
        "huge": (x * 1e200, x[:50] * 1e200),
        "tiny": (x * 1e-180, x[:50]),
        "mixed": (x * 10.0 ** rng.integers(-200, 200, size=(200, 1)), x[:50]),
        "ties": (rng.integers(0, 3, size=(200, 4)) / 8.0, rng.integers(0, 3, size=(60, 4)) / 8.0),
        "halves": (rng.integers(-2000000, 2000000, size=(200, 1)) / 2e6, np.ones((3, 1))),
    }[kind]


KINDS = ["unit", "copies", "near", "zero", "huge", "tiny", "mixed", "ties", "halves"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("name", ["euclidean", "cosine", "vector_dot", "jl_bounds"])
def test_products_round_as_the_distance_itself(name, kind):
    """What a product's bound leaves open is worked out again: the same rounded values."""
    x, q = _vectors_of(kind)
    metric = catalogue._BLOCK_VALUES[name]
    with np.errstate(all="ignore"):
        got, lost = blocks.rounded_values(metric, x, q, 6)
        want = blocks.half_up(metric(x, q), 6)
    assert lost is None and np.array_equal(got, want, equal_nan=True)


@pytest.mark.parametrize("name", ["euclidean", "cosine", "vector_dot", "jl_bounds"])
def test_products_take_the_place_of_coordinates(name, monkeypatch):
    """No coordinate's column is added up for ordinary vectors."""
    x, q = _vectors_of("unit")
    monkeypatch.setattr(block_distances, "total2", lambda *_: pytest.fail("by coordinates"))
    blocks.rounded_values(catalogue._BLOCK_VALUES[name], x[1::4], q, 6)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("k", [1, 5, 300])
def test_nearest_by_products(kind, k):
    """The same rows in the same order as by the distances themselves."""
    x, q = _vectors_of(kind)
    ids = pa.array(np.random.default_rng(7).permutation(len(x)))
    with np.errstate(all="ignore"):
        r, c, value = blocks._nearest(block_distances.euclidean, x, q, ids, k)
        all_values = block_distances.euclidean(x, q)
    rows, columns = blocks._least(all_values, ids, k)
    assert np.array_equal(r, rows) and np.array_equal(c, columns) and np.array_equal(value, all_values[rows, columns])


def test_nearest_works_out_few_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(2000, 8)), rng.normal(size=(30, 8))
    monkeypatch.setattr(block_distances, "total2", lambda *_: pytest.fail("all pairs"))
    assert len(blocks._nearest(block_distances.euclidean, x, q, pa.array(np.arange(2000)), 5)[0]) == 150


def test_fuzzy_hamming_of_small_numbers(monkeypatch):
    """Where no two numbers exceed one together, the greater is all there is to it."""
    rng = np.random.default_rng(9)
    x, q = rng.uniform(-0.5, 0.5, size=(90, 6)), rng.uniform(-0.5, 0.49, size=(40, 6))
    a, b = np.clip(x, 0, 1)[:, None], np.clip(q, 0, 1)
    want = np.zeros((90, 40))
    for j in range(6):
        want += np.maximum(np.minimum(a[..., j], 1 - b[:, j]), np.minimum(1 - a[..., j], b[:, j]))
    of, calls = block_distances._of, []
    monkeypatch.setattr(block_distances, "_of", lambda *v: calls.append(v[0]) or of(*v))
    assert np.array_equal(block_distances.fuzzy_hamming(x, q), want)
    assert calls == [np.maximum] * 12


def test_pairs_are_made_of_arrays(spark):
    """Python hands over a row for each vector and block of queries, not one for each pair."""
    plan = catalogue.QUERIES["distance_mahalanobis"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan
