from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sparkwell.functions import distances, kernels, sql
from sparkwell.operators import timeseries


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark)


def test_scalars_equal_the_columns(spark, names):
    rows = [(1, [1.0, -2.0, 0.5], [0.0, 4.0, 0.5], 0.3), (2, [0.0], [0.0], -1.0), (3, None, [1.0], 1.5), (4, [1.0], [2.0], None)]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>, z double")
    df.createOrReplaceTempView("numbers")
    got = spark.sql("""SELECT id, euclidean_distance(a, b) e, manhattan_distance(a, b) m, chebyshev_distance(a, b) c, minkowski_distance(a, b, 3) k,
        uniform_kernel(z) u, triangular_kernel(z) t, epanechnikov_kernel(z) p, gaussian_kernel(z) g, clamp(z, 0, 1) l, dnorm(z, 0, 2) n, dexp(z, 2) x FROM numbers ORDER BY id""")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    want = df.select(
        "id", distances.euclidean(a, b), distances.manhattan(a, b), distances.chebyshev(a, b), distances.minkowski(a, b, 3.0),
        kernels.uniform(z), kernels.triangular(z), kernels.epanechnikov(z), kernels.gaussian(z), F.least(F.lit(1.0), F.greatest(F.lit(0.0), z)),
    ).orderBy("id").collect()
    for g, w in zip(got.collect(), want, strict=True):
        for j, v in enumerate(w):
            if w["id"] == 4 and j == 9:
                assert g[j] is None
            elif v is not None:
                assert g[j] == pytest.approx(v)
    first = got.first()
    assert first["n"] == pytest.approx(math.exp(-0.5 * 0.15**2) / (2 * math.sqrt(2 * math.pi))) and first["x"] == pytest.approx(2 * math.exp(-0.6))
    assert spark.sql("SELECT dnorm(1, 0, -1), dexp(-1, 2), clamp(NULL, 0, 1)").first() == (None, 0.0, None)


def test_frequency_table(spark, names):
    spark.sql("SELECT * FROM VALUES ('a', 1), ('b', 2), ('a', 3), (NULL, 4), (NULL, 5), ('a', 6) t(v, i)").createOrReplaceTempView("words")
    got = spark.sql("SELECT * FROM frequency_table(TABLE(SELECT v FROM words) PARTITION BY v)").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 3), ("b", 1), (None, 2)], key=str)
    assert spark.sql("SELECT * FROM frequency_table(TABLE(SELECT v FROM words WHERE i > 9) PARTITION BY v)").count() == 0


def test_lag_matrix(spark, names):
    df = spark.createDataFrame([("k", i, float(i * i) if i != 7 else None) for i in range(12)] + [("j", i, 1.0 * i) for i in range(3)], "key string, t int, x double")
    df.createOrReplaceTempView("series")
    got = spark.sql("SELECT * FROM lag_matrix(2, TABLE(SELECT key, x, t FROM series) PARTITION BY key ORDER BY t)").collect()
    found = {(r["key"], r["position"] - 1): (r["target"], *r["lags"]) for r in got}
    want = {(k, r["t"]): (r["target"], r["lag1"], r["lag2"]) for k in "kj" for r in timeseries.lag_matrix(df.where(F.col("key") == k), "x", "t", 2).collect()}
    assert found == want and ("j", 2) in found and ("k", 8) not in found
