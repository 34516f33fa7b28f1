from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell.functions import distances, distributions, qubit, special, vectors
from sparkwell.functions.expr import clean, erf, log_gamma, normal, uniform


def one(spark, **columns):
    return list(spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first())


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


@pytest.mark.parametrize("x", [0.1, 0.5, 1.0, 2.5, 10.0, 171.0])
def test_log_gamma(spark, x):
    assert one(spark, v=log_gamma(x))[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("x", [-7.0, -3.0, -0.2, 0.0, 1e-8, 0.7, 2.0, 5.5, 8.0])
def test_erf(spark, x):
    assert one(spark, v=erf(x))[0] == pytest.approx(math.erf(x), abs=1e-13)


def test_clean_makes_nan_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert df.agg(F.avg(clean("x")), F.max(clean("x")), F.count(clean("x"))).first()[:] == (2.0, 3.0, 2)


_RNG = np.random.default_rng(20)
X, Y = (tuple(_RNG.normal(2, 5, 6).round(2).tolist()) for _ in range(2))


def test_distances(spark):
    x, y = arr(*X), arr(*Y)
    a, b = np.array(X), np.array(Y)
    got = one(
        spark,
        l2=distances.euclidean(x, y), l1=distances.manhattan(x, y), sup=distances.chebyshev(x, y), sup_ref=distances.chebyshev(x, y, "reference"),
        p=distances.minkowski(x, y, 3), pearson=distances.pearson(x, y), bc=distances.bray_curtis(x, y), inf=distances.minkowski(x, y, float("inf")),
    )
    d = np.abs(a - b)
    want = [np.sqrt((d**2).sum()), d.sum(), d.max(), d[1:].max(), (d**3).sum() ** (1 / 3), 1 - np.corrcoef(a, b)[0, 1], d.sum() / (np.abs(a) + np.abs(b)).sum(), d.max()]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("name", ["euclidean", "manhattan", "chebyshev", "canberra", "bray_curtis", "clark", "soergel", "hassanat", "cosine", "pearson"])
def test_metric_properties(spark, name):
    f = getattr(distances, name)
    same, there, back = one(spark, a=f(arr(*X), arr(*X)), b=f(arr(*X), arr(*Y)), c=f(arr(*Y), arr(*X)))
    assert same == pytest.approx(0, abs=1e-7)
    assert there == pytest.approx(back)


def test_aitchison(spark):
    a, b = np.array([0.1, 0.2, 0.5, 0.1, 0.1]), np.array([0.2, 0.1, 0.4, 0.1, 0.2])
    d = np.log(a) - np.log(b)
    want = math.sqrt(sum((d[i] - d[j]) ** 2 for i in range(5) for j in range(i)))
    got, bad = one(spark, v=distances.aitchison(arr(*a), arr(*b)), w=distances.aitchison(arr(1, 2), arr(0.5, 0.5)))
    assert got == pytest.approx(want) and bad is None


def test_hamming_bits(spark):
    a, b = "This is a test!", "This is a nest."
    want = sum((x ^ y).bit_count() for x, y in zip(a.encode(), b.encode(), strict=True))
    assert one(spark, v=distances.hamming_bits(F.lit(a), F.lit(b)), w=distances.hamming_bits(F.lit(""), F.lit("x"))) == [want, 0]


@pytest.mark.parametrize("p", [1e-7, 0.001, 0.02, 0.2, 0.5, 0.77, 0.95, 0.9999])
def test_normal_quantiles(spark, p):
    want = NormalDist().inv_cdf(p)
    q = distributions
    got = one(spark, a=q.qnorm(p), b=q.qnorm_acklam(p), c=q.qnorm_odeh_evans(p), d=q.qnorm_beasley_springer(p), e=q.qnorm_hastings_68(p), f=q.qnorm_hastings_67(p), g=q.pnorm(q.qnorm(p)))
    assert got[0] == pytest.approx(want, abs=1e-13)
    assert got[1] == pytest.approx(want, rel=2e-9, abs=1e-8)
    assert got[2:4] == pytest.approx([want] * 2, abs=1e-4)
    assert got[4] == pytest.approx(want, abs=6e-4)
    assert got[5] == pytest.approx(want, abs=4e-3)
    assert got[6] == pytest.approx(p, abs=1e-12)


@pytest.mark.parametrize("p", [0.01, 0.3, 0.5, 0.9])
def test_other_normal_quantiles(spark, p):
    q, want = distributions, NormalDist().inv_cdf(p)
    got = one(spark, a=q.qnorm_hill_davis(p), b=q.qnorm_bailey(p), c=q.qnorm_bailey_central(p), d=q.qnorm_koehler(p), e=q.qnorm_bailey(p, mode="reference"))
    assert got[:4] == pytest.approx([want] * 4, abs=2e-2)
    assert got[4] == pytest.approx(-want, abs=2e-2)


@pytest.mark.parametrize("p", [0.05, 0.31, 0.5, 0.83])
def test_cdf_of_quantile(spark, p):
    q = distributions
    pairs = {
        "unif": q.punif(q.qunif(p, 2, 5), 2, 5), "exp": q.pexp(q.qexp(p, 0.3), 0.3), "laplace": q.plaplace(q.qlaplace(p, 1, 2), 1, 2), "logis": q.plogis(q.qlogis(p, 1, 2), 1, 2),
        "cauchy": q.pcauchy(q.qcauchy(p, 1, 2), 1, 2), "cos": q.pcos(q.qcos(p, 1, 2), 1, 2), "triang": q.ptriang(q.qtriang(p, 1, 2), 1, 2), "lnorm": q.plnorm(q.qlnorm(p, 1, 2), 1, 2),
    }
    assert one(spark, **pairs) == pytest.approx([p] * len(pairs), abs=1e-9)


def test_discrete_distributions(spark):
    q = distributions
    n, pr = 12, 0.35
    pmf = [math.comb(n, k) * pr**k * (1 - pr) ** (n - k) for k in range(n + 1)]
    got = one(spark, d=q.dbinom(4.0, n, pr), p=q.pbinom(4.0, n, pr), q0=q.qbinom(0.0, n, pr), q1=q.qbinom(1.0, n, pr), qm=q.qbinom(sum(pmf[:5]), n, pr), bad=q.dbinom(1.0, n, 1.5))
    assert got[:2] == pytest.approx([pmf[4], sum(pmf[:5])])
    assert got[2:5] == [0.0, float(n), 4.0] and got[5] is None
    hyper = [math.comb(5, k) * math.comb(2, 3 - k) / math.comb(7, 3) for k in range(1, 4)]
    got = one(spark, d=q.dhyper(2.0, 5, 2, 3), p=q.phyper(2.0, 5, 2, 3), r=q.phyper(2.0, 5, 2, 3, "reference"), g=q.pgeom(3.0, 0.2), z=q.dbinom(0.0, 3, 0.0))
    assert got == pytest.approx([hyper[1], hyper[0] + hyper[1], hyper[0], 1 - 0.8**4, 1.0])


def test_draws_do_not_depend_on_partitions(spark):
    a = spark.range(1000).repartition(7).select("id", uniform(3, "id").alias("u"), normal(3, "id").alias("z"))
    b = spark.range(1000).coalesce(1).select("id", uniform(3, "id").alias("u"), normal(3, "id").alias("z"))
    assert a.exceptAll(b).count() == 0
    m = spark.range(20000).select(uniform(1, "id").alias("u"), normal(1, "id").alias("z"), distributions.rgamma(2.0, 1.5, 4, "id").alias("g"), distributions.rpois(3.0, 5, "id").alias("p"))
    row = m.agg(F.avg("u"), F.avg("z"), F.var_samp("z"), F.avg("g"), F.avg("p"), F.var_samp("p")).first()
    assert list(row) == pytest.approx([0.5, 0, 1, 3.0, 3.0, 3.0], abs=0.08)


def test_bits(spark):
    got = one(spark, a=special.pack_bits(F.array(*[F.lit(v) for v in (1, 0, 1, 1)])), b=special.pack_bits(F.array(*[F.lit(0.7)] * 64)), c=special.pack_bits(F.array(*[F.lit(1)] * 65)), d=special.unpack_bits(F.lit(13), 8))
    assert got == [13, -1, 0, [1, 0, 1, 1, 0, 0, 0, 0]]


def test_vectors(spark):
    got = one(spark, a=vectors.inv(arr(2, 0)), b=vectors.inv(arr(2, 0), 1.0), c=vectors.divide(arr(1, 1), arr(4, 0), 0.0), d=vectors.outer_flat(arr(1, 2), arr(3, 4), True), e=vectors.det3(arr(2, 0, 1, 1, 3, 2, 1, 1, 1)))
    assert got == [[0.5, None], [0.5, 1.0], [0.25, 0.0], [3.0, 6.0, 4.0, 8.0], pytest.approx(np.linalg.det([[2, 0, 1], [1, 3, 2], [1, 1, 1]]))]


def test_driver_derivatives():
    f = lambda v: float(v[0] ** 2 * v[1] + 3 * v[1])
    x = np.array([1.5, -2.0])
    assert special.gradient(f, x) == pytest.approx([-6.0, 5.25], abs=1e-6)
    assert special.hessian(f, x) == pytest.approx(np.array([[-4, 3], [3, 0]]), abs=1e-5)
    assert special.directional_derivative(f, x, np.array([3.0, 4.0])) == pytest.approx(0.6 * -6 + 0.8 * 5.25, abs=1e-6)


def test_gates_keep_the_norm(spark):
    q = qubit.state(0.6, 0.0, 0.0, 0.8)
    for g in (qubit.X, qubit.Y, qubit.Z, qubit.SQRT_NOT, qubit.HADAMARD, qubit.rotation("x", 1.0), qubit.rotation("y", 1.0), qubit.rotation("z", 1.0), qubit.phase_shift(0.3)):
        r = spark.range(1).select(qubit.apply(g, q).alias("q")).first()[0]
        assert sum(v * v for v in r) == pytest.approx(1)
    twice = qubit.apply(qubit.SQRT_NOT, qubit.apply(qubit.SQRT_NOT, q))
    a, b = (spark.range(1).select(v.alias("q")).first()[0] for v in (twice, qubit.apply(qubit.X, q)))
    assert list(a) == pytest.approx(list(b))


def test_draws_take_listed_steps_and_draw_once(spark):
    """Draws of whole numbers with stated parameters do not add up probabilities for each
    row, and shares draw each of their parts once."""
    from sparkwell.functions import distributions as D
    from sparkwell.functions.expr import uniform

    ids = spark.range(3000)
    listed = {"binomial": D.rbinom(20, 0.4, 2, "id"), "hypergeometric": D.rhyper(6, 7, 5, 4, "id"), "poisson": D.rpois(3.0, 5, "id"), "none": D.rbinom(0, 0.4, 2, "id"), "few": D.rhyper(2, 9, 10, 6, "id")}
    scanned = {
        "binomial": D.qbinom(uniform(2, "id"), 20, 0.4), "hypergeometric": D.qhyper(uniform(4, "id"), 6, 7, 5), "poisson": D.qpois(uniform(5, "id"), 3.0),
        "none": D.qbinom(uniform(2, "id"), 0, 0.4), "few": D.qhyper(uniform(6, "id"), 2, 9, 10),
    }
    got, want = (ids.select("id", *[c.alias(n) for n, c in x.items()]) for x in (listed, scanned))
    assert got.collect() == want.collect()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan(got) and "aggregate(" in plan(want)
    assert plan(ids.select(D.runifsimplex(3, 18, "id").alias("s"))).count("md5(") == 3
    shares = ids.select(D.runifsimplex(3, 18, "id").alias("s"), D.rdirichlet([1.0, 2.0], 17, "id").alias("d"), D.rbeta(2.0, 3.0, 16, "id").alias("b")).collect()
    assert all(abs(sum(r["s"]) - 1) < 1e-12 and abs(sum(r["d"]) - 1) < 1e-12 and 0 < r["b"] < 1 for r in shares)


def test_distribution_draws_are_dealt_out(spark, tmp_path):
    """A table of one row group is drawn in many tasks."""
    from sparkwell.plans import catalogue

    spark.range(50_000).select(F.col("id").alias("event_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert catalogue.QUERIES["distribution_draws"](spark, str(tmp_path)).rdd.getNumPartitions() == 3
