from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwell.functions import kernels
from sparkwell.operators import cluster, descriptive, glm, iforest, linear, neighbors, networks, optimize, quantiles, sampling, tables, textdist, timeseries, trees
from sparkwell.functions import distances
from sparkwell.sources.store import load_model, save_model
from sparkwell.streaming import online


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=400)
    z = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x[:, 0])))).astype(float)
    c = rng.poisson(np.exp(0.5 + 0.4 * x[:, 0])).astype(float)
    rows = [(i, float(a), float(b), float(u), float(v), float(w)) for i, ((a, b), u, v, w) in enumerate(zip(x, y, z, c, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, z double, c double").cache(), x, y, z, c


ONE = lambda: F.lit(1.0)


def test_means_skip_nan_and_empty_groups(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", float("nan")), ("p", 4.0), ("q", None)], "g string, x double")
    got = {r["g"]: r for r in descriptive.profile(df, "x", ["g"]).collect()}
    assert (got["p"]["n"], got["p"]["mean"], got["p"]["geometric_mean"], got["p"]["harmonic_mean"]) == (2, 2.5, 2.0, 1.6)
    assert got["q"]["n"] == 0 and got["q"]["mean"] is None and got["q"]["cv_pop"] is None
    assert df.where("g = 'p'").agg(descriptive.weighted_mean("x", F.lit(0.0))).first()[0] is None


def test_entropy_needs_probabilities(spark):
    good = spark.createDataFrame([(0.5,), (0.25,), (0.25,), (0.0,)], "p double")
    assert descriptive.entropy(good, "p").first()[0] == pytest.approx(1.5 * math.log(2))
    assert descriptive.entropy(good.where("p > 0.3"), "p").first()[0] is None


def test_quantile_rule(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 7)], "x double")
    got = [r[1] for r in quantiles.quantiles(df, "x", [0.0, 0.1, 0.5, 0.75, 1.0]).orderBy("prob").collect()]
    assert got == pytest.approx([1, 1, 3, 4.5, 6])
    ref = [r[1] for r in quantiles.quantiles(df, "x", [0.1], mode="reference").collect()]
    assert ref == pytest.approx([1.6])
    single = spark.createDataFrame([(7.0,), (float("nan"),)], "x double")
    assert list(quantiles.fivenum(single, "x").first()) == [7.0] * 5
    assert quantiles.quantiles(single.limit(0), "x", [0.5]).count() == 0


def test_dominated_share_is_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    p = rng.integers(0, 9, size=(300, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "k long, a double, b double")
    got = {r[0]: r[1] for r in quantiles.dominated_share(df, "k", "a", "b").collect()}
    for i, v in enumerate(p):
        assert got[i] == pytest.approx((p <= v).all(1).mean())


@pytest.mark.parametrize("columns", [1, 2, 3, 4])
def test_dominance_in_any_number_of_columns(spark, columns):
    rng = np.random.default_rng(6)
    p = rng.integers(0, 7, size=(150, columns)).astype(float)
    rows = [(i, *map(float, r)) for i, r in enumerate(p)] + [(900, *[None] * columns), (901, *[float("nan")] * columns)]
    names = [f"c{i}" for i in range(columns)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in names))
    got = {r[0]: r[1] for r in quantiles.dominated_share_of(df, "k", names).collect()}
    assert got.keys() == {*range(150)}
    for i, v in enumerate(p):
        assert got[i] == pytest.approx((p <= v).all(1).mean())
    assert quantiles.dominated_share_of(df.limit(0), "k", names).count() == 0


def test_dominance_rows_grow_with_the_square_of_the_logarithm(spark):
    """What is filed for n points of three columns, against n log^2 n."""
    from sparkwell.plans import ranks

    for n in (64, 1024):
        digits = n.bit_length()
        every, below = ranks._blocks(F.col("id"), digits)
        sizes = spark.range(n).select(F.avg(F.size(every)), F.max(F.size(below))).first()
        assert sizes[0] == digits and sizes[1] <= digits


def test_histogram_over_all_bin_counts(spark, monkeypatch):
    from sparkwell.operators import tables

    monkeypatch.setattr(tables, "PIECE", 7)
    monkeypatch.setattr(tables, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=60), rng.normal(8, 0.2, size=30), [8.0] * 10]).round(2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
    got = {r[0]: r[1] for r in tables.penalised_likelihood(df, "x").collect()}
    z = (x - x.min()) / (x.max() - x.min())
    want = {}
    for b in range(1, len(x)):
        c = np.bincount(np.minimum(np.floor(z * b), b - 1).astype(int)).astype(float)
        c = c[c > 0]
        want[b] = (c * np.log(c * b / len(x))).sum() - (b - 1 + np.log(b) ** 2.5)
    assert got == pytest.approx(want)
    best = max(want, key=lambda b: (want[b], -b))
    assert {r["bin"] for r in tables.best_histogram(df, "x").collect()} <= {*range(best)}
    assert tables.penalised_likelihood(df.where("x = 8"), "x").count() == 0


def test_least_squares(data):
    df, x, y, _, _ = data
    m = np.column_stack([np.ones(400), x])
    want = np.linalg.lstsq(m, y, rcond=None)[0]
    assert glm.ols(df, "y", [ONE(), "a", "b"]).coefficients == pytest.approx(want)
    r = y - m @ want
    assert glm.coefficient_covariance(df, "y", [ONE(), "a", "b"]) == pytest.approx(np.linalg.inv(m.T @ m) * (r @ r) / 397, rel=1e-6)
    w = np.abs(x[:, 0]) + 0.1
    assert glm.ols(df, "y", [ONE(), "b"], F.abs("a") + 0.1).coefficients == pytest.approx(np.linalg.lstsq(m[:, [0, 2]] * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0])


def test_generalised_models(data):
    df, x, _, z, c = data
    m = np.column_stack([np.ones(400), x[:, 0]])
    for y, fit, mean, curve in (
        (z, glm.logit(df, "z", [ONE(), "a"]), lambda e: 1 / (1 + np.exp(-e)), lambda mu: mu * (1 - mu)),
        (c, glm.log_link(df, "c", [ONE(), "a"]), np.exp, lambda mu: mu),
    ):
        beta = np.zeros(2)
        for _ in range(50):
            mu = mean(m @ beta)
            beta = beta + np.linalg.solve(m.T @ (m * curve(mu)[:, None]), m.T @ (y - mu))
        assert fit.coefficients == pytest.approx(beta, abs=1e-7)


def test_robust_and_stagewise(data):
    df = data[0]
    spiked = df.withColumn("y", F.when(F.col("id") < 20, F.col("y") + 100).otherwise(F.col("y")))
    assert glm.least_absolute(spiked, "y", [ONE(), "a", "b"], steps=30).coefficients == pytest.approx([1, 2, -1], abs=0.05)
    fit = glm.forward_stagewise(df, "y", ["a", "b"], bound=2.0)
    assert np.abs(fit.coefficients).sum() <= 2.0


def test_capture_recapture(spark):
    rng = np.random.default_rng(2)
    seen = (rng.random((4000, 2)) < [0.6, 0.4]).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in seen], "u double, v double")
    lists = [("u", [ONE()]), ("v", [ONE()])]
    betas = glm.capture_recapture(df, lists, 60, 0.05, 0.0)
    n = glm.population_size(df, lists, betas).first()[0]
    assert n == pytest.approx(4000, rel=0.1)


def test_matrices(data):
    df, x = data[0], data[1]
    assert linear.covariance(df, ["a", "b"]) == pytest.approx(np.cov(x.T, bias=True))
    q = np.array([[r["q0"], r["q1"]] for r in linear.qr_q(df, ["a", "b"]).collect()])
    assert q.T @ q == pytest.approx(np.eye(2), abs=1e-9)
    a = np.array([[0.0, 2, 1], [3, 1, 4], [1, 5, 9]])
    perm, low, up = linear.lu(a)
    assert low @ up == pytest.approx(a[perm])
    assert linear.lu_solve(perm, low, up, np.array([1.0, 2, 3])) == pytest.approx(np.linalg.solve(a, [1, 2, 3]))
    r = np.triu(np.abs(a) + np.eye(3))
    assert linear.sqrt_upper(r) @ linear.sqrt_upper(r) == pytest.approx(r)
    assert linear.inverse_upper(r) @ r == pytest.approx(np.eye(3))
    s = a @ a.T
    v = linear.dominant_eigenvector(s)
    assert s @ v == pytest.approx((v @ s @ v) * v) and (v @ s @ v) == pytest.approx(np.linalg.eigvalsh(s)[-1])


def test_tall_skinny_decomposition_keeps_orthogonality(spark):
    """Columns of condition 1e10: Cholesky's root of the Gram matrix fails on them."""
    rng = np.random.default_rng(9)
    u, _ = np.linalg.qr(rng.normal(size=(800, 5)))
    v, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    x = (u * np.geomspace(1, 1e-10, 5)) @ v.T
    names = [f"x{j}" for j in range(5)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in names)).repartition(7)
    found, r = linear.tall_skinny_qr(df, names)
    q = np.array([[row[f"q{j}"] for j in range(5)] for row in found.orderBy("id").collect()])
    assert np.abs(q.T @ q - np.eye(5)).max() < 1e-12
    assert np.abs(q @ r - x).max() < 1e-14 and (np.diag(r) > 0).all() and np.allclose(r, np.triu(r))
    want = np.linalg.qr(x, mode="r")
    assert np.allclose(np.abs(np.diag(r)), np.abs(np.diag(want)), rtol=1e-4)
    assert found.columns == ["id", *names, *(f"q{j}" for j in range(5))]
    assert linear.tall_skinny_r(df.limit(0), names) == pytest.approx(np.zeros((5, 5)))
    with pytest.raises(np.linalg.LinAlgError):
        linear.tall_skinny_qr(df.withColumn("x1", F.col("x0")), names)


@pytest.mark.parametrize("kernel", [kernels.epanechnikov, kernels.uniform])
def test_band_join_smooths_as_all_pairs_do(spark, kernel):
    rng = np.random.default_rng(10)
    nan = float("nan")
    rows = [([float(a), float(b)], float(c)) for a, b, c in rng.normal(size=(300, 3)).round(2)] + [([nan, 0.5], 3.0), ([0.1, nan], 2.0)] + [([0.25, 0.25], 1.0)] * 60
    asks = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(30, 2)).round(2))] + [(50, [nan, 0.0]), (51, [9.0, 9.0]), (52, [0.25, nan])]
    r, q = spark.createDataFrame(rows, "x array<double>, y double"), spark.createDataFrame(asks, "query long, q array<double>")
    taken = lambda df: {k: v for k, v in df.collect() if v is not None}
    near = taken(neighbors.local_average(q, r, kernel, 0.5, compact=True))
    assert near == pytest.approx(taken(neighbors.local_average(q, r, kernel, 0.5))) and len(near) > 20
    line, ask = r.select(F.get("x", 0).alias("x"), "y").where("not isnan(x)"), q.select("query", F.get("q", 0).alias("q")).where("not isnan(q)")
    assert taken(neighbors.local_linear(ask, line, kernel, 0.5, compact=True)) == pytest.approx(taken(neighbors.local_linear(ask, line, kernel, 0.5)), rel=1e-6)
    formed = neighbors.near_pairs(ask, line, 0.5, F.col("x"), F.col("q"))
    assert formed.where(F.abs(F.col("x") - F.col("q")) > 0.5001).count() == 0
    assert formed.count() < 0.5 * line.count() * ask.count()


def test_series(spark):
    rng = np.random.default_rng(3)
    x = np.zeros(3000)
    for t in range(1, 3000):
        x[t] = 0.6 * x[t - 1] + rng.normal()
    df = spark.createDataFrame([(t, float(v)) for t, v in enumerate(x)], "t long, x double").repartition(5)
    assert timeseries.fit_ar(df, "x", "t", 1).ar == pytest.approx([0.6], abs=0.05)
    d = [r["diff"] for r in timeseries.difference(df, "x", "t", 2).orderBy("t").collect()]
    assert d == pytest.approx(np.diff(x, 2))
    e = rng.normal(size=3000)
    y = e.copy()
    y[1:] += 0.5 * e[:-1]
    ma = spark.createDataFrame([(t, float(v)) for t, v in enumerate(y)], "t long, x double")
    assert timeseries.fit_ma(ma, "x", "t", 1, 10).ma == pytest.approx([0.5], abs=0.07)


def test_windows_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "BLOCK", 8)
    df = spark.range(100).select(F.col("id").alias("t"), F.col("id").cast("double").alias("x")).repartition(7)
    rows = timeseries.shifted(df, "x", "t", [-3, 0, 2]).orderBy("t").collect()
    assert len(rows) == 100
    for r in rows:
        t = r["t"]
        assert [r["_s0"], r["_s1"], r["_s2"]] == [t - 3 if t >= 3 else None, t, t + 2 if t < 98 else None]


def test_neighbours_and_ties(spark):
    rows = spark.createDataFrame([(1, [0.0], 1.0), (2, [0.0], 2.0), (3, [1.0], 9.0)], "id long, x array<double>, y double")
    q = spark.createDataFrame([(7, [0.0])], "query long, q array<double>")
    near = neighbors.nearest(q, rows, 2, distances.euclidean).orderBy("rank").collect()
    assert [r["id"] for r in near] == [1, 2]
    assert neighbors.knn_regression(q, rows, 2, distances.euclidean).first()["prediction"] == 1.5
    assert neighbors.knn_classification(q, rows, 2, distances.euclidean).first()["prediction"] == 1.0
    assert neighbors.nearest_one(q, rows, distances.euclidean).first()["id"] == 1
    assert neighbors.nearest(q.limit(0), rows, 2, distances.euclidean).count() == 0


def test_kendall_and_spearman_of_equal_orders(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(20)], "k long, x double, y double")
    assert neighbors.kendall_distance(df, "x", "y").first()[0] == pytest.approx(0)
    assert neighbors.kendall_distance(df, "x", "y", "reference").first()[0] == pytest.approx(-1)
    assert neighbors.spearman_distance(df, "k", "x", "y").first()[0] == pytest.approx(0)


def test_kendall_matches_all_pairs(spark):
    rng = np.random.default_rng(3)
    p = rng.integers(-6, 7, size=(150, 2))
    want = sum(np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]) for i, a in enumerate(p) for b in p[:i]) * 2 / (150 * 149)
    rows = [(float(a), float(b)) for a, b in p] + [(None, 1.0), (2.0, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert neighbors.kendall_distance(df, "x", "y").first()[0] == pytest.approx((1 - want) / 2)
    assert neighbors.kendall_distance(df.limit(0), "x", "y").first()[0] == pytest.approx(0.5)
    assert neighbors.kendall_distance(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double"), "x", "y").first()[0] == pytest.approx(0.5)


def test_chisini_mean_of_sums_and_means(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 40)] + [(None,)], "x double")
    v = np.arange(1.0, 40)
    assert descriptive.chisini_mean(df, "x", lambda c: F.sum(c * c)) == pytest.approx(np.sqrt((v * v).mean()))
    assert descriptive.chisini_mean(df, "x", lambda c: F.avg(1 / c)) == pytest.approx(1 / (1 / v).mean())


def test_k_means_keeps_empty_cells(spark):
    df = spark.createDataFrame([([0.0],), ([1.0],), ([10.0],), ([11.0],)], "x array<double>")
    c = cluster.k_means(df, "x", 3, 5, [[0.0], [12.0], [1000.0]])
    assert c.points == [[0.5], [10.5], [1000.0]]


@pytest.mark.parametrize("kind", ["projection", "gap", "prototype", "steinhaus", "deep"])
def test_isolation_scores_an_outlier_highest(spark, kind):
    rng = np.random.default_rng(4)
    p = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(200)] + [(999, [9.0, -9.0, 9.0])]
    df = spark.createDataFrame(p, "id long, x array<double>")
    f = iforest.isolation_forest(df, "id", "x", 60, 64, kind)
    for how in ("mean_depth", "mean_score", "conorm"):
        top = iforest.anomaly_scores(df, "id", "x", f, how).orderBy(F.desc("score")).limit(3).collect()
        assert 999 in [r["id"] for r in top]


def test_trees_find_a_step_and_a_line(data, spark):
    df = data[0].withColumn("s", F.when(F.col("a") > 0.2, 5.0).otherwise(1.0))
    t = trees.grow_tree(df, "s", ["a", "b"], 3, 64)
    err = df.select(F.avg(F.abs(t.predict() - F.col("s")))).first()[0]
    assert err < 0.1 and t.splits[0].feature == 0
    line = trees.grow_tree(df, "y", ["a", "b"], 4, 16, rules=("constant", "linear", "lines"), slack=1.5)
    assert df.select(F.avg(F.abs(line.predict() - F.col("y")))).first()[0] < 0.3


def test_nets_and_memory(data, spark, tmp_path):
    df = data[0]
    net = networks.fit_link_net(df, "y", ["a", "b"])
    assert df.select(F.corr(net.predict(), F.col("y"))).first()[0] > 0.99
    save_model(spark, net, f"{tmp_path}/net")
    again = load_model(spark, networks.LinkNet, f"{tmp_path}/net")
    assert again.weights == pytest.approx(net.weights) and again.features == net.features
    patterns = [0b1010101010101010, 0b1111000011110000]
    memory = networks.train_hopfield(spark.createDataFrame([(p,) for p in patterns], "p long"), "p", 16)
    assert [memory.recall(p ^ 1) for p in patterns] == patterns
    assert memory.energy(patterns[0]) < memory.energy(patterns[0] ^ 0b111)


def test_samples(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.lit(0.2).alias("p"))
    assert sampling.simple_without_replacement(df, "k", 40, 1).count() == 40
    assert sampling.simple_with_replacement(df, "k", 300, 1).agg(F.sum("count")).first()[0] == 300
    assert sampling.multinomial(df, "k", "p", 300, 1).agg(F.sum("count")).first()[0] == 300
    assert sampling.conditional_poisson(df, "k", "p", 100, 1).count() == 100
    assert sampling.pareto(df, "k", "p", 100, 1).count() == 100
    assert sampling.systematic(df, "k", "p", start=0.5).count() == 100
    assert 60 < sampling.poisson(df, "k", "p", 1).count() < 140
    assert sampling.multinomial(df.limit(0), "k", "p", 5, 1).count() == 0
    a = sampling.poisson(df.repartition(9), "k", "p", 1).select("k")
    assert a.exceptAll(sampling.poisson(df.coalesce(1), "k", "p", 1).select("k")).count() == 0


def test_resampling(spark):
    df = spark.range(400).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"))
    b = sampling.bootstrap(df, "k", "x", 40, F.avg, 1)
    assert b.count() == 40 and b.agg(F.avg("value")).first()[0] == pytest.approx(199.5, abs=4)
    s = sampling.subsample(df, "k", "x", 100, 30, F.median, 1)
    assert s.count() == 30 and s.agg(F.avg("value")).first()[0] == pytest.approx(199.5, abs=15)


def test_histogram_of_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert tables.histogram(df, "x", 4).first()["count"] == 5
    assert tables.normalized_mutual_information(df, "x", "x").first()[0] is None


def test_text_distances():
    a, b, c = (s.encode() for s in ("This is a test! " * 8, "This is a test! " * 8, "0123456789abcdefghij" * 6))
    assert textdist.lz_jaccard(a, b) == 0 and textdist.lz_jaccard(a, c) > 0.8
    assert textdist.ncd_zlib(a, b) < textdist.ncd_zlib(a, c)
    assert textdist.lz_jaccard(b"", b"") == 0


F2 = lambda v: float((v[0] - 1) ** 2 + 4 * (v[1] + 2) ** 2 + 0.5 * v[0] * v[1])
G2 = lambda v: np.array([2 * (v[0] - 1) + 0.5 * v[1], 8 * (v[1] + 2) + 0.5 * v[0]])
H2 = np.array([[2, 0.5], [0.5, 8]])
BEST = np.linalg.solve(H2, [2, -16])


@pytest.mark.parametrize("name, steps, kw", [("adam", 4000, {"rate": 0.01}), ("yogi", 6000, {}), ("rmsprop", 6000, {"rate": 0.005}), ("adagrad", 6000, {"rate": 0.5}), ("adadelta", 20000, {}), ("lion", 8000, {"decay": 0.0}), ("adamw", 4000, {"rate": 0.01, "decay": 0.0})])
def test_first_order(name, steps, kw):
    assert getattr(optimize, name)(np.zeros(2), G2, steps, **kw) == pytest.approx(BEST, abs=0.3 if name == "adadelta" else 0.05)


def test_second_order():
    assert optimize.gauss_newton(np.zeros(2), G2, lambda v: H2, 1) == pytest.approx(BEST)
    assert optimize.third_order(np.zeros(2), G2, lambda v: H2, 2) == pytest.approx(BEST)
    t = np.linspace(0, 1, 30)
    error = lambda v: v[0] * np.exp(v[1] * t) - 2 * np.exp(-1.5 * t)
    jacobian = lambda v: np.column_stack([np.exp(v[1] * t), v[0] * t * np.exp(v[1] * t)])
    for f in (optimize.levenberg, optimize.marquardt):
        assert f(np.array([1.0, 0.0]), error, jacobian, 60) == pytest.approx([2, -1.5], abs=1e-6)


@pytest.mark.parametrize("order", ["cyclic", "random", "greedy", "sweep"])
def test_coordinate_descent(order):
    assert optimize.coordinate_descent(np.zeros(2), F2, 60, order) == pytest.approx(BEST, abs=1e-3)


def test_other_descents():
    assert optimize.steepest_coordinate(np.zeros(2), F2, 3000, 0.05) == pytest.approx(BEST, abs=1e-3)
    for pick in ("greedy", "random", "semigreedy"):
        assert F2(optimize.accelerated_coordinate(np.zeros(2), F2, 2000, 0.02, pick)) == pytest.approx(F2(BEST), abs=0.05)
    for order in ("cyclic", "random", "greedy"):
        assert optimize.block_descent(np.zeros(2), F2, 1, 300, order) == pytest.approx(BEST, abs=1e-2)
    assert optimize.adaptive_block_descent(np.zeros(2), F2, 300) == pytest.approx(BEST, abs=0.05)
    lasso = optimize.proximal_gradient(np.zeros(2), G2, lambda v: 3 * np.abs(v).sum(), 60, 0.1)
    assert abs(lasso[0]) < 0.5 and lasso[1] < -1


def test_constrained():
    w = optimize.minimise_on_simplex(3, lambda v: 2 * (v - np.array([0.5, 0.3, 0.2])), 800)
    assert w == pytest.approx([0.5, 0.3, 0.2], abs=0.02)
    x = optimize.binary_quadratic(3, lambda v: 2 * (v - np.array([0.9, 0.1, 0.8])))
    assert x.tolist() == [1, 0, 1]
    c, a, b = np.array([-5.0, -4, -3]), np.array([[2.0, 3, 1]]), np.array([3.0])
    for f in (optimize.binary_linear_penalty, optimize.binary_linear_admm):
        x = f(c, a, b)
        assert (a @ x <= b).all() and c @ x == -8


def test_streamed_means(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1.0), ("p", 4.0), ("q", float("nan")), ("q", 2.0)], "g string, x double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = online.file_stream(spark, f"{tmp_path}/in", rows.schema, 10)
    query = online.online_mean(stream, "x", ["g"], "geometric").writeStream.outputMode("complete").format("memory").queryName("means").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["g"], r["n"], r["mean"]) for r in spark.table("means").collect()} == {("p", 2, 2.0), ("q", 1, 2.0)}


def test_windowed_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2020-01-01 00:00:10' t, 'p' g, 2.0D x UNION ALL SELECT timestamp'2020-01-01 00:00:50', 'p', 4.0D UNION ALL SELECT timestamp'2020-01-01 00:05:00', 'p', 8.0D")
    rows.write.parquet(f"{tmp_path}/in")
    stream = online.file_stream(spark, f"{tmp_path}/in", rows.schema, 10)
    query = online.windowed_mean(stream, "x", "t", "1 minute", "1 minute", ["g"]).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["n"], r["mean"]) for r in spark.table("windows").collect()) == [(1, 8.0), (2, 3.0)]


@pytest.mark.parametrize("most", [200_000, 40])
def test_lz_jaccard_of_tables(spark, monkeypatch, most):
    r = random.Random(21)
    monkeypatch.setattr(textdist, "MOST_PHRASES", most)
    texts = ["".join(r.choice("abc é") for _ in range(r.randrange(0, 80))) for _ in range(30)] + ["", None, "a" * 3000, "", "ab"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "abc", "x"), (4, texts[4], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, query string").repartition(3)
    out = textdist.lz_jaccard_to(df, df.where("doc_id % 3 = 0"))
    assert out.columns == ["doc_id", "query", "value"]
    got = sorted(out.collect(), key=str)
    want = []
    for i, a, _ in rows:
        for j, b, _ in rows:
            if j is not None and j % 3 == 0:
                value = None if a is None or b is None else textdist.lz_jaccard(a.encode(), b.encode())
                want.append((i, j, value))
    assert len(got) == len(want)
    assert [(x[0], x[1]) for x in sorted(got, key=lambda x: (str(x[0]), x[1]))] == [(x[0], x[1]) for x in sorted(want, key=lambda x: (str(x[0]), x[1]))]
    exact = {(x[0], x[1]): x[2] for x in want}
    assert all(x[2] == pytest.approx(exact[x[0], x[1]]) if x[2] is not None else exact[x[0], x[1]] is None for x in got)
    assert textdist.lz_jaccard_to(df.limit(0), df).count() == 0 and textdist.lz_jaccard_to(df, df.limit(0)).count() == 0


def test_phrases_by_trie():
    r = random.Random(22)
    for _ in range(200):
        data = bytes(r.choice(b"ab\0c") for _ in range(r.randrange(200)))
        assert set(textdist._parse(data)) == textdist.lz_phrases(data)
        assert len(textdist._parse(data)) == len(textdist.lz_phrases(data))


def test_dominated_counts_nest_the_columns_of_few_values(spark, monkeypatch):
    """The rows that are filed hang on the values of the columns, not on their order."""
    from sparkwell.plans import ranks

    filed = []

    def counted(df, by, order, *names):
        if by:
            filed.append(df.count())
        return plain(df, by, order, *names)

    plain = ranks.running_sum
    monkeypatch.setattr(ranks, "running_sum", counted)
    cells = spark.range(600).select(F.col("id").cast("double").alias("a"), F.pmod(F.col("id") * 7, F.lit(3)).alias("b"), F.pmod("id", F.lit(5)).alias("c"), F.lit(1).cast("long").alias("w"))
    got = [{(r["a"], r["b"], r["c"]): r["_n"] for r in ranks.dominated_counts(cells, names, "w").collect()} for names in (["a", "b", "c"], ["b", "c", "a"])]
    assert got[0] == got[1] and len(got[0]) == 600 and filed[0] == filed[1] < 600 * 15
    rows = [(i, i * 7 % 3, i % 5) for i in range(600)]
    assert all(got[0][r] == sum(all(x <= y for x, y in zip(o, r, strict=True)) for o in rows) for r in rows[::37])


def test_bins_of_a_piece_are_runs():
    """A block of bin counts over one piece, its counts looked up or not."""
    rng = np.random.default_rng(3)
    z = np.unique(np.concatenate([[0.0, 1.0], rng.random(80).round(3)]))
    c = rng.integers(1, 9, len(z))
    flog = lambda v: np.where(v > 0, v * np.log(np.maximum(v, 1)), 0.0)
    assert tables._block_starts(5000)[0] == 1 and tables._block_starts(5000)[-1] == 5001
    for part in (slice(0, len(z)), slice(0, 30), slice(30, len(z))):
        zs, cs = z[part], c[part]
        for known in (flog(np.arange(cs.sum() + 1)), None):
            out = tables._block(zs, cs, np.diff(zs), float(flog(cs).sum()), known, 1, 1500).to_pylist()
            for b in (1, 2, 3, 17, 400, 1499):
                bins = np.minimum(np.floor(zs * b), b - 1).astype(int)
                want = np.bincount(bins, weights=cs)
                mine = {r["bin"]: r["v"] for r in out if r["bins"] == b}
                assert mine.pop(-1) == pytest.approx(flog(want).sum() - flog(want[[bins[0]]]).sum() - (flog(want[[bins[-1]]]).sum() if bins[-1] > bins[0] else 0), abs=1e-9)
                assert mine == {int(i): want[i] for i in {bins[0], bins[-1]}}


def test_lz_jaccard_common_and_rare_phrases(spark, monkeypatch):
    """Phrases counted by the product, by the index in pieces, and rounded as Spark rounds."""
    r = random.Random(23)
    texts = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(60))) for _ in range(50)]
    sets = [textdist.lz_phrases(t.encode()) for t in texts]
    for common, hits in ((4096, 1 << 20), (3, 5), (0, 1)):
        monkeypatch.setattr(textdist, "COMMON", common)
        monkeypatch.setattr(textdist, "HITS", hits)
        index = textdist._Index(pa.array([list(s) for s in sets], pa.list_(pa.binary())))
        number = {p: i for i, p in enumerate(index.known.to_pylist())}
        ids = np.array([number[p] for s in sets for p in s])
        at = np.repeat(np.arange(50), [len(s) for s in sets])
        assert index.shared(ids, at, 50).tolist() == [[len(a & b) for b in sets] for a in sets]
    values = [1 - i / n for n in (64, 128, 640, 3200, 20000, 999) for i in range(0, n, 3)]
    spark_rounds = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", F.round("v", 6).alias("v")).orderBy("i").collect()
    assert textdist._rounded(np.array(values)[:, None], 6)[:, 0].tolist() == [r["v"] for r in spark_rounds]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = textdist.lz_jaccard_to(df, df, digits=6)._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan
