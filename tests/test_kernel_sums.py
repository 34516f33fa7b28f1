from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sparkwell.functions import kernels
from sparkwell.operators import neighbors

SHAPE = "id long, x double, y double"
DATA = [(i, round(math.sin(i * 1.7) * 6 + (i % 7) * 0.3, 2), float(i % 5)) for i in range(400)]
ODD = [(500, None, 1.0), (501, 1e13, 2.0), (502, 0.5, None), (503, 60.0, 3.0), (504, -200.0, 4.0)]


def _two(spark, data):
    rows = spark.createDataFrame(data, SHAPE)
    return rows.where("id % 3 = 0").select(F.col("id").alias("query"), F.col("x").alias("q")), rows


def _arrays(q, r):
    return q.withColumn("q", F.array("q")), r.withColumn("x", F.array("x"))


def _taken(df):
    return {r["query"]: r["prediction"] for r in df.collect()}


def _same(got, want):
    assert got.keys() == want.keys() and len(want) > 100
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v, rel=1e-9, abs=1e-9)), k


@pytest.mark.parametrize("data", [DATA, DATA + ODD], ids=["plain", "odd"])
def test_gauss_smoothers_equal_the_pairs(spark, data):
    by_pairs = lambda z: kernels.gaussian(z)  # noqa: E731  (another function: no cells)
    q, r = _two(spark, data)
    _same(_taken(neighbors.local_average(*_arrays(q, r), kernels.gaussian, 0.8)), _taken(neighbors.local_average(*_arrays(q, r), by_pairs, 0.8)))
    q = q.where("query < 501")  # far away a line hangs on rounding
    _same(_taken(neighbors.local_linear(q, r, kernels.gaussian, 0.8)), _taken(neighbors.local_linear(q, r, by_pairs, 0.8)))


def test_gauss_smoothers_without_any_y(spark):
    q, r = _two(spark, [(i, x, None) for i, x, _ in DATA])
    assert set(_taken(neighbors.local_average(*_arrays(q, r), kernels.gaussian, 0.8)).values()) == {None}
    assert _taken(neighbors.local_linear(q, r.limit(0), kernels.gaussian, 0.8)) == {}


@pytest.mark.parametrize("kernel", [kernels.uniform, kernels.epanechnikov, kernels.quartic, kernels.triweight])
def test_polynomial_smoothers_equal_the_pairs(spark, kernel):
    q, r = _two(spark, DATA + ODD)
    near = neighbors.local_average(*_arrays(q, r), kernel, 1.5, compact=True)
    _same(_taken(near), _taken(neighbors.local_average(*_arrays(q, r), lambda z: kernel(z), 1.5, compact=True)))


def test_smoothers_form_no_pairs(spark):
    q, r = _two(spark, DATA)
    for found in (neighbors.local_average(*_arrays(q, r), kernels.gaussian, 0.8), neighbors.local_linear(q, r, kernels.gaussian, 0.8)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    near = neighbors.local_average(*_arrays(q, r), kernels.epanechnikov, 1.5, compact=True)
    assert "_cell" in near._jdf.queryExecution().toString() and "n0" in near._jdf.queryExecution().toString()
