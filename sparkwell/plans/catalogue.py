"""Queries of the statistical operators over whole tables, with equivalent SQL.

``QUERIES`` maps a name to a function of the session and a data folder;
``ORACLE_SQL`` holds DuckDB SQL for those that have an SQL form.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import block_distances as B
from ..functions import distances, distributions, kernels, qubit, special, vectors
from ..functions.expr import bound, erf, log_gamma, uniform
from ..operators import cluster, descriptive, forests, glm, iforest, linear, metric_index, neighbors, networks, optimize, quantiles, records, sampling, tables, textdist, timeseries, trees
from ..sources.dictionary import describe, dictionary
from ..sources.store import Graph, load_model, save_model, shared_folder, table
from ..streaming import online
from . import fits_sql, forests_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _c(name: str) -> Column:
    return F.col(name)


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, minus zero made zero, so that results can be compared."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


# Descriptive statistics, by return flag.

_BY = "SELECT l_returnflag, {} FROM lineitem GROUP BY l_returnflag"
_CENTRED = """WITH m AS (SELECT l_returnflag g, avg(l_quantity) mu FROM lineitem GROUP BY 1),
c AS (SELECT g, l_quantity - mu d, mu FROM lineitem JOIN m ON l_returnflag = g)
SELECT g AS l_returnflag, {} FROM c GROUP BY g"""
_WEIGHTED = """WITH m AS (SELECT l_returnflag g, sum(l_quantity * l_discount) / sum(l_quantity) mu FROM lineitem GROUP BY 1),
c AS (SELECT g, l_discount - mu d, l_quantity w FROM lineitem JOIN m ON l_returnflag = g)
SELECT g AS l_returnflag, {} FROM c GROUP BY g"""


def _by_flag(name: str, stat: Callable[[], Column], sql: str, template: str = _BY, digits: int = 6) -> None:
    add(
        name,
        lambda s, d: rounded(table(s, d, "lineitem").groupBy("l_returnflag").agg(stat().alias("value")), digits),
        template.format(f"round({sql}, {digits}) + 0.0::DOUBLE AS value"),
    )


_q = "l_quantity"
_by_flag("mean_arithmetic", lambda: descriptive.mean(_q), "avg(l_quantity)")
_by_flag("mean_geometric", lambda: descriptive.geometric_mean(_q), "exp(avg(ln(l_quantity)))")
_by_flag("mean_harmonic", lambda: descriptive.harmonic_mean(_q), "count(*) / sum(1.0::DOUBLE / l_quantity)")
_by_flag("mean_harmonic_reference", lambda: descriptive.harmonic_mean(_q, "reference"), "count(*) / (1 + sum(1.0::DOUBLE / l_quantity))")
_by_flag("mean_generalized", lambda: descriptive.generalized_mean(_q, F.sqrt, lambda m: m * m), "pow(avg(sqrt(l_quantity)), 2)")
_by_flag("mean_weighted", lambda: descriptive.weighted_mean("l_extendedprice", _q), "sum(l_quantity * l_extendedprice) / sum(l_quantity)", digits=3)
_by_flag("second_moment", lambda: descriptive.raw_moment(_q, 2), "avg(l_quantity * l_quantity)")
_by_flag("variance_population", lambda: descriptive.pop_variance(_q), "var_pop(l_quantity)")
_by_flag("variance_sample", lambda: descriptive.smp_variance(_q), "var_samp(l_quantity)")
_by_flag("cv_population", lambda: descriptive.pop_cv(_q), "stddev_pop(l_quantity) / avg(l_quantity)")
_by_flag("cv_sample", lambda: descriptive.smp_cv(_q), "stddev_samp(l_quantity) / avg(l_quantity)")
_by_flag("third_moment", lambda: descriptive.raw_moment(_q, 3), "avg(pow(l_quantity, 3))", digits=3)
_by_flag("third_central_moment", lambda: descriptive.third_central_moment(_q), "avg(pow(d, 3))", _CENTRED, 4)
_by_flag("skewness", lambda: descriptive.skewness(_q), "avg(pow(d, 3)) / pow(avg(d * d), 1.5)", _CENTRED)
_by_flag("fourth_moment", lambda: descriptive.raw_moment(_q, 4), "avg(pow(l_quantity, 4))", digits=1)
_by_flag("fourth_central_moment", lambda: descriptive.fourth_central_moment(_q), "avg(pow(d, 4))", _CENTRED, 3)
_by_flag("kurtosis", lambda: descriptive.kurtosis(_q), "avg(pow(d, 4)) / pow(avg(d * d), 2)", _CENTRED)
_by_flag("kurtosis_normalized", lambda: descriptive.normalized_kurtosis(_q), "avg(pow(d, 4)) / pow(avg(d * d), 2) / 3", _CENTRED)
_by_flag("minimum_value", lambda: descriptive.minimum("l_extendedprice"), "min(l_extendedprice)")
_by_flag("maximum_value", lambda: descriptive.maximum("l_extendedprice"), "max(l_extendedprice)")
_by_flag("range_value", lambda: descriptive.value_range("l_extendedprice"), "max(l_extendedprice) - min(l_extendedprice)")
_by_flag("weighted_second_moment", lambda: descriptive.weighted_raw_moment("l_discount", _q, 2), "sum(l_quantity * pow(l_discount, 2)) / sum(l_quantity)", digits=9)
_by_flag("weighted_third_moment", lambda: descriptive.weighted_raw_moment("l_discount", _q, 3), "sum(l_quantity * pow(l_discount, 3)) / sum(l_quantity)", digits=9)
_by_flag("weighted_fourth_moment", lambda: descriptive.weighted_raw_moment("l_discount", _q, 4), "sum(l_quantity * pow(l_discount, 4)) / sum(l_quantity)", digits=9)
_by_flag("weighted_variance", lambda: descriptive.weighted_variance("l_discount", _q), "sum(w * d * d) / sum(w)", _WEIGHTED, 9)
_by_flag("weighted_third_central_moment", lambda: descriptive.weighted_central_moment("l_discount", _q, 3), "sum(w * pow(d, 3)) / sum(w)", _WEIGHTED, 9)
_by_flag("weighted_fourth_central_moment", lambda: descriptive.weighted_central_moment("l_discount", _q, 4), "sum(w * pow(d, 4)) / sum(w)", _WEIGHTED, 9)
_by_flag("weighted_skewness", lambda: descriptive.weighted_skewness("l_discount", _q), "sum(w * pow(d, 3)) / sum(w) / pow(sum(w * d * d) / sum(w), 1.5)", _WEIGHTED)
_by_flag("weighted_kurtosis", lambda: descriptive.weighted_kurtosis("l_discount", _q), "sum(w * pow(d, 4)) / sum(w) / pow(sum(w * d * d) / sum(w), 2)", _WEIGHTED)
_by_flag("weighted_kurtosis_normalized", lambda: descriptive.weighted_normalized_kurtosis("l_discount", _q), "sum(w * pow(d, 4)) / sum(w) / pow(sum(w * d * d) / sum(w), 2) / 3", _WEIGHTED)
_by_flag("mgf_univariate", lambda: descriptive.mgf(_q, 0.05), "avg(exp(0.05::DOUBLE * l_quantity))")
_by_flag("mgf_multivariate", lambda: descriptive.multivariate_mgf([_q, "l_discount"], [0.02, 1.5]), "avg(exp(0.02::DOUBLE * l_quantity + 1.5::DOUBLE * l_discount))")
_by_flag("mean_generalized_weighted", lambda: descriptive.generalized_weighted_mean("l_discount", F.col("l_quantity") / 1e6, F.sqrt, lambda m: m * m), "pow(sum(l_quantity / 1e6 * sqrt(l_discount)), 2)")
_by_flag("n_categories", lambda: tables.n_categories("l_linenumber").cast("double"), "count(DISTINCT l_linenumber)::DOUBLE")

add(
    "mean_geometric_product",
    lambda s, d: rounded(table(s, d, "nation").groupBy("n_regionkey").agg(descriptive.geometric_mean_product(F.col("n_nationkey") + 1).alias("value"))),
    "SELECT n_regionkey, round(pow(product(n_nationkey + 1), 1.0::DOUBLE / count(*)), 6) AS value FROM nation GROUP BY 1",
)
add(
    "profile",
    lambda s, d: rounded(descriptive.profile(table(s, d, "lineitem"), _q, ["l_returnflag"])),
    _CENTRED.format(
        """count(*) AS n, round(avg(mu + d), 6) AS mean, round(exp(avg(ln(mu + d))), 6) AS geometric_mean,
round(count(*) / sum(1.0::DOUBLE / (mu + d)), 6) AS harmonic_mean, round(var_pop(d), 6) AS var_pop, round(var_samp(d), 6) AS var_smp,
round(stddev_pop(d) / avg(mu + d), 6) AS cv_pop, round(stddev_samp(d) / avg(mu + d), 6) AS cv_smp,
round(avg(pow(d, 3)) / pow(avg(d * d), 1.5), 6) + 0.0::DOUBLE AS skewness, round(avg(pow(d, 4)) / pow(avg(d * d), 2), 6) AS kurtosis,
round(min(mu + d), 6) AS min, round(max(mu + d), 6) AS max, round(max(mu + d) - min(mu + d), 6) AS range"""
    ),
)
add(
    "characteristic_univariate",
    lambda s, d: rounded(table(s, d, "lineitem").groupBy("l_returnflag").agg(descriptive.characteristic(_q, 0.1).alias("c")).select("l_returnflag", "c.re", "c.im")),
    _BY.format("round(avg(cos(0.1::DOUBLE * l_quantity)), 6) AS re, round(avg(sin(0.1::DOUBLE * l_quantity)), 6) AS im"),
)
add(
    "characteristic_multivariate",
    lambda s, d: rounded(table(s, d, "lineitem").groupBy("l_returnflag").agg(descriptive.multivariate_characteristic([_q, "l_tax"], [0.1, 2.0]).alias("c")).select("l_returnflag", "c.re", "c.im")),
    _BY.format("round(avg(cos(0.1::DOUBLE * l_quantity + 2.0::DOUBLE * l_tax)), 6) AS re, round(avg(sin(0.1::DOUBLE * l_quantity + 2.0::DOUBLE * l_tax)), 6) AS im"),
)


def _entropy(mode: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        events = table(s, d, "events")
        n = events.count()
        p = events.groupBy("event_type").agg((F.count("*") / n).alias("p"))
        return rounded(descriptive.entropy(p, "p", mode))

    return run


_P = "WITH c AS (SELECT count(*)::DOUBLE c FROM events GROUP BY event_type), p AS (SELECT c / (SELECT sum(c) FROM c) p FROM c) "
add("entropy", _entropy("standard"), _P + "SELECT round(-sum(p * ln(p)), 6) AS entropy FROM p")
add("entropy_reference", _entropy("reference"), _P + "SELECT round(sum(p * ln(p)), 6) AS entropy FROM p")


def _chisini(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "nation").select((F.col("n_nationkey") + 1.0).alias("x"))
    m = descriptive.chisini_mean(rows, "x", lambda v: F.sum(v * v))
    return rounded(s.createDataFrame([(m,)], "chisini double"))


add("chisini_mean", _chisini, "SELECT round(sqrt(avg(pow(n_nationkey + 1, 2))), 6) AS chisini FROM nation")
add(
    "frechet_variance",
    lambda s, d: rounded(table(s, d, "lineitem").agg(descriptive.frechet_variance(None, F.abs(F.col(_q) - 25)).alias("value"))),
    "SELECT round(avg(pow(abs(l_quantity - 25), 2)), 6) AS value FROM lineitem",
)


def _frechet(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select("l_quantity", "l_linenumber")
    at = descriptive.frechet_mean(
        rows, lambda p: F.sqrt(F.pow(F.col("l_quantity") - p[0], F.lit(2.0)) + F.pow(F.col("l_linenumber") - p[1], F.lit(2.0))), [20.0, 2.0], 4.0
    )
    return rounded(s.createDataFrame([tuple(at)], "x double, y double"), 2)


add("frechet_mean", _frechet, "SELECT round(avg(l_quantity), 2) AS x, round(avg(l_linenumber), 2) AS y FROM lineitem")
add(
    "grouped_user_statistic",
    lambda s, d: rounded(table(s, d, "customer").groupBy("c_mktsegment").agg(descriptive.grouped_udf(lambda x: float((x - x.mean()).abs().mean()))("c_acctbal").alias("value")), 4),
    """WITH m AS (SELECT c_mktsegment g, avg(c_acctbal) mu FROM customer GROUP BY 1)
SELECT c_mktsegment, round(avg(abs(c_acctbal - mu)), 4) AS value FROM customer JOIN m ON g = c_mktsegment GROUP BY 1""",
)

# Quantiles and empirical distributions.

_RANKED = "WITH r AS (SELECT l_extendedprice x, l_returnflag g, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) i, count(*) OVER (PARTITION BY l_returnflag) n FROM lineitem)"


def _type4(p: float) -> str:
    pos = f"greatest(floor(n * {p} + 1e-9), 1)"
    return (
        f"max(CASE WHEN i = {pos} THEN x END) + max(greatest(n * {p}::DOUBLE - {pos}, 0)) * "
        f"(max(CASE WHEN i = least({pos} + 1, n) THEN x END) - max(CASE WHEN i = {pos} THEN x END))"
    )


add(
    "quantiles",
    lambda s, d: rounded(quantiles.quantiles(table(s, d, "lineitem"), "l_extendedprice", [0.1, 0.25, 0.5, 0.9], ["l_returnflag"]), 4),
    _RANKED + " UNION ALL ".join(f" SELECT g AS l_returnflag, {p}::DOUBLE AS prob, round({_type4(p)}, 4) AS quantile FROM r GROUP BY g" for p in (0.1, 0.25, 0.5, 0.9)),
)
add(
    "fivenum",
    lambda s, d: rounded(quantiles.fivenum(table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"]), 4),
    _RANKED + "SELECT g AS l_returnflag, " + ", ".join(f"round({_type4(p)}, 4) AS {n}" for p, n in zip((0.0, 0.25, 0.5, 0.75, 1.0), ("minimum", "lower", "middle", "upper", "maximum"), strict=True)) + " FROM r GROUP BY g",
)
add(
    "iqr",
    lambda s, d: rounded(quantiles.iqr(table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"]), 4),
    _RANKED + f"SELECT g AS l_returnflag, round(({_type4(0.75)}) - ({_type4(0.25)}), 4) AS iqr FROM r GROUP BY g",
)
add("median", lambda s, d: rounded(table(s, d, "lineitem").groupBy("l_returnflag").agg(quantiles.median("l_extendedprice").alias("value")), 4), _BY.format("round(median(l_extendedprice), 4) AS value"))
_CUM = """WITH s AS (SELECT l_returnflag g, l_extendedprice x, sum(l_quantity) w FROM lineitem GROUP BY 1, 2),
c AS (SELECT g, x, sum(w) OVER (PARTITION BY g ORDER BY x) c, sum(w) OVER (PARTITION BY g) t FROM s) """
add(
    "weighted_median",
    lambda s, d: rounded(quantiles.weighted_median(table(s, d, "lineitem"), "l_extendedprice", _q, ["l_returnflag"]), 4),
    _CUM + "SELECT g AS l_returnflag, round(min(x), 4) AS weighted_median FROM c WHERE c >= 0.5 * t - 1e-9 GROUP BY g",
)
add(
    "weighted_quantile",
    lambda s, d: rounded(quantiles.weighted_quantile(table(s, d, "lineitem"), "l_extendedprice", _q, 0.3, ["l_returnflag"]), 4),
    _CUM + "SELECT g AS l_returnflag, round(min(x), 4) AS quantile FROM c WHERE c >= 0.3 * t - 1e-9 GROUP BY g",
)
add(
    "weighted_iqr",
    lambda s, d: rounded(quantiles.weighted_iqr(table(s, d, "lineitem"), "l_discount", _q)),
    """WITH s AS (SELECT l_discount x, sum(l_quantity) w FROM lineitem GROUP BY 1), c AS (SELECT x, sum(w) OVER (ORDER BY x) c, sum(w) OVER () t FROM s)
SELECT round(min(x) FILTER (WHERE c >= 0.75 * t - 1e-9) - min(x) FILTER (WHERE c >= 0.25 * t - 1e-9), 6) AS weighted_iqr FROM c""",
)
add(
    "ecdf",
    lambda s, d: rounded(quantiles.ecdf(table(s, d, "events"), "value"), 9),
    "SELECT DISTINCT round(value, 9) AS value, round(cume_dist() OVER (ORDER BY value), 9) AS ecdf FROM events",
)
add("ecdf_at", lambda s, d: rounded(table(s, d, "events").agg(quantiles.ecdf_at("value", 50.0).alias("share"))), "SELECT round(avg((value <= 50)::INT), 6) AS share FROM events")
add("survival_at", lambda s, d: rounded(table(s, d, "events").agg(quantiles.ecdf_at("value", 50.0, "reference").alias("share"))), "SELECT round(avg((value > 50)::INT), 6) AS share FROM events")
for _name, _closed, _cond in (
    ("erpp", "right", "l_quantity > 10 AND l_quantity <= 20 AND l_discount > 0.02 AND l_discount <= 0.05"),
    ("ecrpp", "both", "l_quantity >= 10 AND l_quantity <= 20 AND l_discount >= 0.02 AND l_discount <= 0.05"),
    ("eorpp", "none", "l_quantity > 10 AND l_quantity < 20 AND l_discount > 0.02 AND l_discount < 0.05"),
):
    add(
        f"box_share_{_name}",
        lambda s, d, c=_closed: rounded(table(s, d, "lineitem").agg(quantiles.box_share([_q, "l_discount"], [10, 0.02], [20, 0.05], c).alias("share"))),
        f"SELECT round(avg(({_cond.replace('0.02', '0.02::DOUBLE').replace('0.05', '0.05::DOUBLE')})::INT), 6) AS share FROM lineitem",
    )
add(
    "joint_ecdf_at",
    lambda s, d: rounded(table(s, d, "lineitem").agg(quantiles.joint_ecdf_at([_q, "l_tax"], [25, 0.04]).alias("share"))),
    "SELECT round(avg((l_quantity <= 25 AND l_tax <= 0.04::DOUBLE)::INT), 6) AS share FROM lineitem",
)
add(
    "dominated_share",
    lambda s, d: rounded(quantiles.dominated_share(table(s, d, "customer"), "c_custkey", "c_acctbal", "c_nationkey"), 9),
    """SELECT a.c_custkey, round(count(*) / (SELECT count(*) FROM customer)::DOUBLE, 9) AS share FROM customer a
JOIN customer b ON b.c_acctbal <= a.c_acctbal AND b.c_nationkey <= a.c_nationkey GROUP BY 1""",
)
add(
    "dominated_share_three",
    lambda s, d: rounded(quantiles.dominated_share_of(table(s, d, "customer").withColumn("third", F.pmod("c_custkey", F.lit(11))), "c_custkey", ["c_acctbal", "c_nationkey", "third"]), 9),
    """SELECT a.c_custkey, round(count(*) / (SELECT count(*) FROM customer)::DOUBLE, 9) AS share FROM customer a
JOIN customer b ON b.c_acctbal <= a.c_acctbal AND b.c_nationkey <= a.c_nationkey AND b.c_custkey % 11 <= a.c_custkey % 11 GROUP BY 1""",
)
_FUZZ = """WITH r AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 0.5::DOUBLE) / count(*) OVER () a,
(row_number() OVER (ORDER BY c_nationkey, c_custkey) - 0.5::DOUBLE) / count(*) OVER () b FROM customer) """
add(
    "rank_share_product",
    lambda s, d: rounded(quantiles.rank_share(table(s, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"]), 9),
    _FUZZ + "SELECT c_custkey, round(a * b, 9) AS share FROM r",
)
add(
    "rank_share_minimum",
    lambda s, d: rounded(quantiles.rank_share(table(s, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"], "minimum"), 9),
    _FUZZ + "SELECT c_custkey, round(least(a, b), 9) AS share FROM r",
)

# Tables.

add("counts_one_way", lambda s, d: tables.counts(table(s, d, "part"), "p_brand"), "SELECT p_brand, count(*) AS count FROM part GROUP BY 1")
add("counts_two_way", lambda s, d: tables.counts(table(s, d, "part"), "p_brand", "p_size"), "SELECT p_brand, p_size, count(*) AS count FROM part GROUP BY 1, 2")
add(
    "one_hot",
    lambda s, d: tables.one_hot(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"]),
    "SELECT o_orderkey, o_orderstatus, (o_orderstatus = 'F')::INT::DOUBLE AS is_0, (o_orderstatus = 'O')::INT::DOUBLE AS is_1, (o_orderstatus = 'P')::INT::DOUBLE AS is_2 FROM orders",
)
add(
    "normalized_mutual_information",
    lambda s, d: rounded(tables.normalized_mutual_information(table(s, d, "lineitem"), "l_extendedprice", _q)),
    """WITH k AS (SELECT floor(sqrt(count(*) / 4))::INT nb, count(*)::DOUBLE n, min(l_extendedprice) x0, max(l_extendedprice) x1, min(l_quantity) y0, max(l_quantity) y1 FROM lineitem),
b AS (SELECT least(floor((l_extendedprice - x0) * (nb / (x1 - x0))), nb - 1) i, least(floor((l_quantity - y0) * (nb / (y1 - y0))), nb - 1) j, n FROM lineitem, k),
p AS (SELECT i, j, count(*) / any_value(n) p FROM b GROUP BY 1, 2),
hx AS (SELECT -sum(q * ln(q)) h FROM (SELECT sum(p) q FROM p GROUP BY i)), hy AS (SELECT -sum(q * ln(q)) h FROM (SELECT sum(p) q FROM p GROUP BY j)),
hxy AS (SELECT -sum(p * ln(p)) h FROM p)
SELECT round((hx.h + hy.h - hxy.h) / least(hx.h, hy.h), 6) AS nmi FROM hx, hy, hxy""",
)
add(
    "histogram",
    lambda s, d: rounded(tables.histogram(table(s, d, "customer"), "c_acctbal", 20), 9),
    """WITH k AS (SELECT min(c_acctbal) a, max(c_acctbal) b, count(*) n FROM customer)
SELECT least(floor((c_acctbal - a) / ((b - a) / 20)), 19)::BIGINT AS bin, count(*) AS count, round(count(*) / (any_value(n) * any_value((b - a) / 20)), 9) AS density FROM customer, k GROUP BY 1""",
)
add(
    "histogram_penalised_likelihood",
    lambda s, d: rounded(tables.penalised_likelihood(table(s, d, "lineitem"), "l_quantity", 30), 3),
    """WITH k AS (SELECT min(l_quantity) a, max(l_quantity) b, count(*)::DOUBLE n FROM lineitem), v AS (SELECT (l_quantity - a) / (b - a) z, n FROM lineitem, k),
c AS (SELECT bins, least(floor(z * bins), bins - 1) i, count(*) c, any_value(n) n FROM v, range(1, 31) t(bins) GROUP BY 1, 2)
SELECT bins, round(sum(c * ln(c * bins / n)) - (bins - 1 + pow(ln(bins), 2.5)), 3) + 0.0::DOUBLE AS likelihood FROM c GROUP BY bins""",
)
add(
    "histogram_penalised_all_bins",
    lambda s, d: rounded(tables.penalised_likelihood(table(s, d, "customer"), "c_acctbal"), 3),
    """WITH k AS (SELECT min(c_acctbal) a, max(c_acctbal) b, count(*)::DOUBLE n FROM customer), v AS (SELECT (c_acctbal - a) / (b - a) z, n, count(*) m FROM customer, k GROUP BY 1, 2),
c AS (SELECT bins, least(floor(z * bins), bins - 1) i, sum(m)::DOUBLE c, any_value(n) n FROM v, range(1, (SELECT count(*) FROM customer)) t(bins) GROUP BY 1, 2)
SELECT bins, round(sum(c * ln(c * bins / n)) - (bins - 1 + pow(ln(bins), 2.5)), 3) + 0.0::DOUBLE AS likelihood FROM c GROUP BY bins""",
)
add(
    "histogram_best",
    lambda s, d: rounded(tables.best_histogram(table(s, d, "lineitem"), "l_quantity", 30)),
    """WITH k AS (SELECT min(l_quantity) a, max(l_quantity) b, count(*)::DOUBLE n FROM lineitem), v AS (SELECT l_quantity q, (l_quantity - a) / (b - a) z, a, b, n FROM lineitem, k),
c AS (SELECT bins, least(floor(z * bins), bins - 1) i, count(*) c, any_value(n) n FROM v, range(1, 31) t(bins) GROUP BY 1, 2),
l AS (SELECT bins, sum(c * ln(c * bins / n)) - (bins - 1 + pow(ln(bins), 2.5)) l FROM c GROUP BY bins), m AS (SELECT bins FROM l ORDER BY l DESC, bins LIMIT 1)
SELECT least(floor((q - a) / ((b - a) / bins)), bins - 1)::BIGINT AS bin, count(*) AS count, round(count(*) / (any_value(n) * any_value((b - a) / bins)), 6) AS density FROM v, m GROUP BY 1""",
)
add(
    "pack_unpack_bits",
    lambda s, d: table(s, d, "part").select("p_partkey", special.pack_bits(special.unpack_bits(F.col("p_partkey"), 64)).alias("packed"), F.concat_ws("", special.unpack_bits(F.col("p_size"), 8)).alias("bits8"), F.concat_ws("", special.unpack_bits(F.col("p_size"), 16)).alias("bits16"), F.concat_ws("", special.unpack_bits(F.col("p_partkey"), 32)).alias("bits32")),
    """SELECT p_partkey, p_partkey AS packed, array_to_string([(p_size >> i) & 1 for i in range(8)], '') AS bits8,
array_to_string([(p_size >> i) & 1 for i in range(16)], '') AS bits16, array_to_string([(p_partkey >> i) & 1 for i in range(32)], '') AS bits32 FROM part""",
)
add(
    "errors",
    lambda s, d: rounded(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", special.absolute_error(F.round(F.col("l_extendedprice")), F.col("l_extendedprice")).alias("absolute"), special.relative_error(F.round(F.col("l_extendedprice")), F.col("l_extendedprice")).alias("relative"), special.approx_value(F.col(_q), 0.01).alias("approx"))),
    "SELECT l_orderkey, l_linenumber, round(round(l_extendedprice) - l_extendedprice, 6) + 0.0::DOUBLE AS absolute, round((round(l_extendedprice) - l_extendedprice) / l_extendedprice, 6) + 0.0::DOUBLE AS relative, round(l_quantity * 1.01::DOUBLE, 6) AS approx FROM lineitem",
)
add(
    "clamp",
    lambda s, d: table(s, d, "customer").select("c_custkey", special.clamp(F.col("c_acctbal"), 0.0, 5000.0).alias("value")),
    "SELECT c_custkey, greatest(0.0::DOUBLE, least(5000.0::DOUBLE, c_acctbal)) AS value FROM customer",
)


def _centred(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer")
    one = rows.agg(((F.min("c_acctbal") + F.max("c_acctbal")) / 2).alias("c"), ((F.max("c_acctbal") - F.min("c_acctbal")) / 2).alias("b"))
    return rounded(rows.crossJoin(F.broadcast(one)).select("c_custkey", (F.col("c_acctbal") - F.col("c")).alias("centred"), "b", "c"), 4)  # one row


add(
    "center",
    _centred,
    "WITH k AS (SELECT (min(c_acctbal) + max(c_acctbal)) / 2 c, (max(c_acctbal) - min(c_acctbal)) / 2 b FROM customer) SELECT c_custkey, round(c_acctbal - c, 4) + 0.0::DOUBLE AS centred, round(b, 4) AS b, round(c, 4) AS c FROM customer, k",
)
add(
    "autoscale",
    lambda s, d: rounded(iforest.autoscale(table(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])),
    """WITH k AS (SELECT quantile_cont(c_acctbal, 0.25) a, quantile_cont(c_acctbal, 0.5) m, quantile_cont(c_acctbal, 0.75) b FROM customer)
SELECT c_custkey, round((c_acctbal - m) / ((b - a) / 1.3489795003921634::DOUBLE), 6) + 0.0::DOUBLE AS c_acctbal FROM customer, k""",
)

# Distances and norms of embeddings from the first one.

_E = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) x FROM embeddings), p AS (SELECT vec_id query, x y FROM e WHERE vec_id % 20 = 0) "


def _of_pairs(s: SparkSession, d: str, column: Callable[[Column, Column], Column], block: B.BlockMetric, digits: int = 6) -> DataFrame:
    """The value of every vector with every twentieth, block by block."""
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("x").alias("q"))
    return neighbors.pair_values(queries, e, "vec_id", column, block, digits)


#: The values of pairs in NumPy, for blocks of vectors and queries.
_BLOCK_VALUES: dict[str, B.BlockMetric] = {
    "euclidean": B.euclidean, "manhattan": B.manhattan, "chebyshev": B.chebyshev, "chebyshev_reference": B.chebyshev_reference, "minkowski": B.minkowski(3), "canberra": B.canberra,
    "bray_curtis": B.bray_curtis, "clark": B.clark, "soergel": B.soergel, "hassanat": B.hassanat, "cosine": B.cosine, "pearson": B.pearson, "fuzzy_hamming": B.fuzzy_hamming,
    "mahalanobis": B.mahalanobis(np.array([[1.23, -0.5], [-0.5, 3.21]])), "steinhaus": B.steinhaus(0.5, B.manhattan), "vector_dot": B.dot, "vector_scalar": B.less_sums(2.0),
    "vector_outer": B.outer_sum(3), "jl_bounds": B.squared(1 + 0.1),
}

#: Queries on single vectors.
_SINGLE = {"l0_norm", "l1_norm", "l2_norm", "linf_norm", "lp_norm", "vector_mean", "vector_normalize", "determinant_2x2", "determinant_3x3"}


def _single(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def _sum2(body: str) -> str:
    return f"list_sum(list_transform(list_zip(x, y), lambda t: {body}))"


def _sum1(body: str, of: str = "x") -> str:
    return f"list_sum(list_transform({of}, lambda v: {body}))"


_SIMPLEX = "list_transform({0}, lambda v: abs(v) / list_sum(list_transform({0}, lambda u: abs(u))))"


def _simplex(v: Column) -> Column:
    return F.transform(v, lambda a: F.abs(a) / F.aggregate(v, F.lit(0.0), lambda s, b: s + F.abs(b)))


for _name, _col, _sql in (
    ("euclidean", lambda x, y: distances.euclidean(x, y), f"sqrt({_sum2('pow(t[1] - t[2], 2)')})"),
    ("manhattan", lambda x, y: distances.manhattan(x, y), _sum2("abs(t[1] - t[2])")),
    ("chebyshev", lambda x, y: distances.chebyshev(x, y), "list_max(list_transform(list_zip(x, y), lambda t: abs(t[1] - t[2])))"),
    ("chebyshev_reference", lambda x, y: distances.chebyshev(x, y, "reference"), "list_max(list_transform(list_zip(x[2:], y[2:]), lambda t: abs(t[1] - t[2])))"),
    ("minkowski", lambda x, y: distances.minkowski(x, y, 3), f"pow({_sum2('pow(abs(t[1] - t[2]), 3)')}, 1.0::DOUBLE / 3)"),
    ("canberra", lambda x, y: distances.canberra(x, y), _sum2("abs(t[1] - t[2]) / (abs(t[1]) + abs(t[2]) + 1e-40)")),
    ("bray_curtis", lambda x, y: distances.bray_curtis(x, y), f"{_sum2('abs(t[1] - t[2])')} / {_sum2('abs(t[1]) + abs(t[2])')}"),
    ("clark", lambda x, y: distances.clark(x, y), f"sqrt({_sum2('pow((t[1] - t[2]) / (abs(t[1]) + abs(t[2])), 2)')})"),
    ("soergel", lambda x, y: distances.soergel(x, y), f"{_sum2('abs(t[1] - t[2])')} / {_sum2('greatest(abs(t[1]), abs(t[2]))')}"),
    ("hassanat", lambda x, y: distances.hassanat(x, y), _sum2("abs(t[1] - t[2]) / (1 + greatest(t[1], t[2]) + CASE WHEN least(t[1], t[2]) < 0 THEN abs(least(t[1], t[2])) ELSE 0 END)")),
    ("cosine", lambda x, y: distances.cosine(x, y), f"sqrt(greatest(0, 2 - 2 * {_sum2('t[1] * t[2]')} / sqrt({_sum1('v * v')} * {_sum1('v * v', 'y')})))"),
    ("pearson", lambda x, y: distances.pearson(x, y), f"1 - ({_sum2('t[1] * t[2]')} - {_sum1('v')} * {_sum1('v', 'y')} / len(x)) / sqrt(({_sum1('v * v')} - pow({_sum1('v')}, 2) / len(x)) * ({_sum1('v * v', 'y')} - pow({_sum1('v', 'y')}, 2) / len(x)))"),
    ("fuzzy_hamming", lambda x, y: distances.fuzzy_hamming(x, y), _sum2("greatest(least(least(1, greatest(0, t[1])), 1 - least(1, greatest(0, t[2]))), least(1 - least(1, greatest(0, t[1])), least(1, greatest(0, t[2]))))")),
    ("mahalanobis", lambda x, y: distances.mahalanobis(F.slice(x, 1, 2), F.slice(y, 1, 2), np.array([[1.23, -0.5], [-0.5, 3.21]])), "sqrt((3.21 * pow(x[1] - y[1], 2) + (x[1] - y[1]) * (x[2] - y[2]) + 1.23 * pow(x[2] - y[2], 2)) / (1.23::DOUBLE * 3.21 - 0.25))"),
    ("steinhaus", lambda x, y: distances.steinhaus(x, y, F.transform(x, lambda _: F.lit(0.5)), distances.manhattan), f"2 * {_sum2('abs(t[1] - t[2])')} / ({_sum2('abs(t[1] - t[2])')} + {_sum1('abs(v - 0.5)')} + {_sum1('abs(v - 0.5)', 'y')})"),
    ("l0_norm", lambda x, y: distances.l0_norm(x).cast("double"), "len(list_filter(x, lambda v: abs(v) > 1e-15))::DOUBLE"),
    ("l1_norm", lambda x, y: distances.l1_norm(x), _sum1("abs(v)")),
    ("l2_norm", lambda x, y: distances.l2_norm(x), f"sqrt({_sum1('v * v')})"),
    ("linf_norm", lambda x, y: distances.linf_norm(x), "list_max(list_transform(x, lambda v: abs(v)))"),
    ("lp_norm", lambda x, y: distances.lp_norm(x, 3), f"pow({_sum1('pow(abs(v), 3)')}, 1.0::DOUBLE / 3)"),
    ("vector_mean", lambda x, y: vectors.mean(x), f"{_sum1('v')} / len(x)"),
    ("vector_dot", lambda x, y: vectors.dot(x, y), _sum2("t[1] * t[2]")),
    ("vector_normalize", lambda x, y: vectors.sum_of(vectors.normalize(x)), f"{_sum1('v')} / sqrt({_sum1('v * v')})"),
    ("vector_scalar", lambda x, y: vectors.sum_of(vectors.scalar(2.0, vectors.elementwise(x, y, lambda a, b: a + b), lambda a, v: a - v)), _sum2("2 - (t[1] + t[2])")),
    ("vector_outer", lambda x, y: vectors.sum_of(vectors.outer_flat(F.slice(x, 1, 3), F.slice(y, 1, 3))), "(x[1] + x[2] + x[3]) * (y[1] + y[2] + y[3])"),
    ("determinant_2x2", lambda x, y: vectors.det2(F.slice(x, 1, 4)), "x[1] * x[4] - x[2] * x[3]"),
    ("determinant_3x3", lambda x, y: vectors.det3(F.slice(x, 1, 9)), "x[1] * (x[5] * x[9] - x[6] * x[8]) - x[2] * (x[4] * x[9] - x[6] * x[7]) + x[3] * (x[4] * x[8] - x[5] * x[7])"),
    ("jl_bounds", lambda x, y: F.get(special.jl_bounds(0.1, x, y), 1), f"1.1::DOUBLE * {_sum2('pow(t[1] - t[2], 2)')}"),
):
    add(
        f"distance_{_name}" if "norm" not in _name and "vector" not in _name and "det" not in _name and "jl" not in _name else _name,
        lambda s, d, c=_col, n=_name: rounded(_single(s, d).select("vec_id", c(_c("x"), None).alias("value"))) if n in _SINGLE else _of_pairs(s, d, c, _BLOCK_VALUES[n]),
        _E + (f"SELECT vec_id, round({_sql}, 6) + 0.0::DOUBLE AS value FROM e" if _name in _SINGLE else f"SELECT vec_id, query, round({_sql}, 6) + 0.0::DOUBLE AS value FROM e, p"),
    )
add(
    "distance_aitchison",
    lambda s, d: _of_pairs(s, d, lambda x, y: distances.aitchison(_simplex(x), _simplex(y)), B.aitchison_of_sizes, 5),
    _E + f", z AS (SELECT vec_id, query, list_transform(list_zip({_SIMPLEX.format('x')}, {_SIMPLEX.format('y')}), lambda t: ln(t[1]) - ln(t[2])) x FROM e, p) "
    f"SELECT vec_id, query, round(sqrt(greatest(0, len(x) * {_sum1('v * v')} - pow({_sum1('v')}, 2))), 5) + 0.0::DOUBLE AS value FROM z",
)
add(
    "distance_hamming_bits",
    lambda s, d: table(s, d, "customer").select("c_custkey", distances.hamming_bits(F.col("c_name"), F.lit("Customer#000000007")).alias("value")),
    "SELECT c_custkey, list_sum(list_transform(range(1, least(length(c_name), 18) + 1), lambda i: bit_count(xor(ascii(substr(c_name, i, 1)), ascii(substr('Customer#000000007', i, 1))))))::BIGINT AS value FROM customer",
)


def _densities(s: SparkSession, d: str) -> DataFrame:
    f, g, h = (lambda t: F.lit(1.0)), (lambda t: 3 * t * t), (lambda t: 1.5 * F.sqrt(t))
    return rounded(
        s.range(1).select(
            distances.hellinger(f, g).alias("hellinger"),
            distances.bhattacharyya(f, g).alias("bhattacharyya"),
            distances.jeffreys(f, g).alias("jeffreys"),
            distances.jensen_shannon(f, g).alias("jensen_shannon"),
            distances.steinhaus_density(f, g, h, distances.hellinger).alias("steinhaus"),
        )
    )


_GRID = "WITH t AS (SELECT i / 100.0::DOUBLE t, CASE WHEN i IN (0, 100) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 300.0::DOUBLE w FROM range(0, 101) r(i)), v AS (SELECT w, 1.0::DOUBLE f, 3 * t * t g, 1.5::DOUBLE * sqrt(t) h FROM t) "
_HEL = "sqrt(abs(1 - sum(w * sqrt({0} * {1}))))"
add(
    "density_distances",
    _densities,
    _GRID
    + f"SELECT round({_HEL.format('f', 'g')}, 6) AS hellinger, round(abs(-ln(sum(w * sqrt(f * g)))), 6) AS bhattacharyya, round(sum(w * pow(sqrt(f) - sqrt(g), 2)), 6) AS jeffreys, "
    "round(sqrt(sum(w * (f * ln(2 * f / (f + g)) + CASE WHEN g > 0 THEN g * ln(2 * g / (f + g)) ELSE 0 END))), 6) AS jensen_shannon, "
    f"round(2 * {_HEL.format('f', 'g')} / ({_HEL.format('f', 'g')} + {_HEL.format('f', 'h')} + {_HEL.format('g', 'h')}), 6) AS steinhaus FROM v",
)

# Kernels and distributions, over the distinct quantities.

_Z = "WITH v AS (SELECT DISTINCT l_quantity q, (l_quantity - 25) / 15 x, l_quantity / 51 p FROM lineitem) "


def _grid(s: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(s, d, "lineitem").select(q.alias("q"), ((q - 25) / 15).alias("x"), (q / 51).alias("p")).distinct()


_A = math.acosh(2)
_KERNEL_SQL = {
    "uniform": "0.5",
    "triangular": "1 - abs(x)",
    "epanechnikov": "0.75 * (1 - x * x)",
    "quartic": "15.0 / 16 * pow(1 - x * x, 2)",
    "triweight": "35.0 / 32 * pow(1 - x * x, 3)",
    "tricube": "70.0::DOUBLE / 81 * pow(1 - pow(abs(x), 3), 3)",
    "cosine": "pi() / 4 * cos(pi() / 2 * x)",
    "hyperbolic_cosine": f"(2 - (exp({_A}::DOUBLE * x) + exp(-{_A}::DOUBLE * x)) / 2) / {4 - 2 * math.sinh(_A) / _A}::DOUBLE",
}
_UNBOUNDED = {
    "laplacian": "0.5 * exp(-abs(x))",
    "silverman": "0.5 * exp(-abs(x) / sqrt(2)) * sin(abs(x) / sqrt(2) + pi() / 4)",
    "gaussian": "exp(-0.5 * x * x) / sqrt(2 * pi())",
}
add(
    "kernels",
    lambda s, d: rounded(_grid(s, d).select("q", *[k(F.col("x")).alias(n) for n, k in kernels.KERNELS.items()]), 9),
    _Z
    + "SELECT q, "
    + ", ".join(
        [f"round(CASE WHEN abs(x) <= 1 THEN {e} ELSE 0 END::DOUBLE, 9) + 0.0::DOUBLE AS {n}" for n, e in _KERNEL_SQL.items()]
        + [f"round({e}, 9) AS {n}" for n, e in _UNBOUNDED.items()]
    )
    + " FROM v",
)


def _pair() -> Column:
    return F.array(F.col("x"), F.col("x") / 2)


add(
    "kernels_multivariate",
    lambda s, d: rounded(
        _grid(s, d).select(
            "q",
            kernels.spherical(_pair(), 2).alias("spherical"),
            kernels.product_one(_pair(), kernels.gaussian).alias("product_one"),
            kernels.product_each(_pair(), [kernels.gaussian, kernels.laplacian]).alias("product_each"),
            kernels.additive_bounded(_pair(), kernels.epanechnikov).alias("additive"),
            kernels.product_bounded(_pair(), [kernels.quartic, kernels.triangular]).alias("product_bounded"),
        ),
        9,
    ),
    _Z
    + """SELECT q, round(CASE WHEN x * x * 1.25 <= 1 THEN 2 / pi() * (1 - x * x * 1.25) ELSE 0 END, 9) AS spherical,
round(exp(-0.5 * x * x) * exp(-0.125 * x * x) / (2 * pi()), 9) AS product_one, round(exp(-0.5 * x * x) / sqrt(2 * pi()) * 0.5 * exp(-abs(x) / 2), 9) AS product_each,
round(CASE WHEN abs(x) < 1 THEN 0.75 * (2 - x * x * 1.25) / 4 ELSE 0 END, 9) AS additive,
round(CASE WHEN abs(x) < 1 THEN 15.0 / 16 * pow(1 - x * x, 2) * (1 - abs(x) / 2) ELSE 0 END, 9) AS product_bounded FROM v""",
)

_ERF = "(2 / sqrt(pi()) * exp(-({0}) * ({0})) * sign({0}) * list_sum(list_transform(range(0, 161), lambda n: exp((2 * n + 1) * ln(greatest(abs({0}), 1e-300)) + 2 * n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2)))))"
_PNORM = f"0.5 * (1 + {_ERF.format('x / sqrt(2)')})"
_LOGC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_dbin = f"exp({_LOGC.format('50', '{0}')} + {{0}} * ln(0.4) + (50 - {{0}}) * ln(0.6))"
_dpoi = "exp({0} * ln(20) - 20 - lgamma({0} + 1))"
_dhyp = f"exp({_LOGC.format('60', '{0}')} + {_LOGC.format('70', '(50 - {0})')} - {_LOGC.format('130', '50')})"


def _upto(term: str) -> str:
    return f"list_sum(list_transform(range(0, q::INT + 1), lambda k: {term.format('k')}))"


def _scan_sql(term: str, last: int) -> str:
    return f"list_min(list_filter(range(0, {last + 1}), lambda j: list_sum(list_transform(range(0, j + 1), lambda k: {term.format('k')})) >= p - 1e-12))::DOUBLE"


D = distributions
for _name, _d, _dsql, _p, _psql, _qq, _qsql in (
    ("bernoulli", lambda: D.dbern(F.pmod(_c("q"), F.lit(2)), 0.3), "CASE WHEN q % 2 = 1 THEN 0.3 ELSE 0.7 END", lambda: D.pbern(_c("x"), 0.3), "CASE WHEN x < 0 THEN 0 WHEN x < 1 THEN 0.7 ELSE 1 END", lambda: D.qbern(_c("p"), 0.3), "(p > 0.7)::INT"),
    ("binomial", lambda: D.dbinom(_c("q"), 50, 0.4), _dbin.format("q"), lambda: D.pbinom(_c("q"), 50, 0.4), f"CASE WHEN q >= 50 THEN 1 ELSE {_upto(_dbin)} END", lambda: D.qbinom(_c("p"), 50, 0.4), _scan_sql(_dbin, 50)),
    ("geometric", lambda: D.dgeom(_c("q"), 0.1), "0.1 * pow(0.9, q)", lambda: D.pgeom(_c("q"), 0.1), "1 - pow(0.9, q + 1)", lambda: D.qgeom(_c("p"), 0.1), "greatest(0, ceil(ln(1 - p) / ln(0.9) - 1 - 1e-12))"),
    ("hypergeometric", lambda: D.dhyper(_c("q"), 60, 70, 50), _dhyp.format("q"), lambda: D.phyper(_c("q"), 60, 70, 50), f"least(1, {_upto(_dhyp)})", lambda: D.qhyper(_c("p"), 60, 70, 50), _scan_sql(_dhyp, 50)),
    ("poisson", lambda: D.dpois(_c("q"), 20.0), _dpoi.format("q"), lambda: D.ppois(_c("q"), 20.0), f"least(1, {_upto(_dpoi)})", lambda: D.qpois(_c("p"), 20.0), _scan_sql(_dpoi, 93)),
    ("uniform", lambda: D.dunif(_c("q"), 5, 30), "CASE WHEN q BETWEEN 5 AND 30 THEN 0.04 ELSE 0 END", lambda: D.punif(_c("q"), 5, 30), "least(1, greatest(0, (q - 5) / 25))", lambda: D.qunif(_c("p"), 5, 30), "5 + 25 * p"),
    ("exponential", lambda: D.dexp(_c("q"), 0.1), "0.1 * exp(-0.1 * q)", lambda: D.pexp(_c("q"), 0.1), "1 - exp(-0.1 * q)", lambda: D.qexp(_c("p"), 0.1), "-ln(1 - p) / 0.1"),
    ("laplace", lambda: D.dlaplace(_c("x"), 0.1, 1.5), "exp(-2 * abs(x - 0.1) / 1.5) / 1.5", lambda: D.plaplace(_c("x"), 0.1, 1.5), "CASE WHEN x < 0.1 THEN 0.5 * exp(-2 * abs(x - 0.1) / 1.5) ELSE 1 - 0.5 * exp(-2 * abs(x - 0.1) / 1.5) END", lambda: D.qlaplace(_c("p"), 0.1, 1.5), "0.1 - 0.75 * sign(p - 0.5) * ln(1 - 2 * abs(p - 0.5))"),
    ("logistic", lambda: D.dlogis(_c("x"), 0.1, 1.5), "exp(-(x - 0.1) / 1.5) / (1.5 * pow(1 + exp(-(x - 0.1) / 1.5), 2))", lambda: D.plogis(_c("x"), 0.1, 1.5), "1 / (1 + exp(-(x - 0.1) / 1.5))", lambda: D.qlogis(_c("p"), 0.1, 1.5), "0.1 + 1.5 * ln(p / (1 - p))"),
    ("cauchy", lambda: D.dcauchy(_c("x"), 0.1, 1.5), "1 / (pi() * 1.5 * (1 + pow((x - 0.1) / 1.5, 2)))", lambda: D.pcauchy(_c("x"), 0.1, 1.5), "0.5 + atan((x - 0.1) / 1.5) / pi()", lambda: D.qcauchy(_c("p"), 0.1, 1.5), "0.1 + 1.5 * tan(pi() * (p - 0.5))"),
    ("raised_cosine", lambda: D.dcos(_c("x"), 0.1, 0.4), "CASE WHEN abs((x - 0.1) / 0.4) <= pi() THEN (1 + cos((x - 0.1) / 0.4)) / (2 * pi() * 0.4) ELSE 0 END", lambda: D.pcos(_c("x"), 0.1, 0.4), "CASE WHEN (x - 0.1) / 0.4 < -pi() THEN 0 WHEN (x - 0.1) / 0.4 > pi() THEN 1 ELSE (pi() + (x - 0.1) / 0.4 + sin((x - 0.1) / 0.4)) / (2 * pi()) END", lambda: D.pcos(D.qcos(_c("p"), 0.1, 0.4), 0.1, 0.4), "p"),
    ("triangular", lambda: D.dtriang(_c("x"), 0.1, 1.5), "greatest(0, (1 - abs(x - 0.1) / 1.5) / 1.5)", lambda: D.ptriang(_c("x"), 0.1, 1.5), "CASE WHEN x <= -1.4 THEN 0 WHEN x >= 1.6 THEN 1 WHEN x < 0.1 THEN pow(1 + (x - 0.1) / 1.5, 2) / 2 ELSE 1 - pow(1 - (x - 0.1) / 1.5, 2) / 2 END", lambda: D.qtriang(_c("p"), 0.1, 1.5), "0.1 + 1.5 * CASE WHEN p < 0.5 THEN sqrt(2 * p) - 1 ELSE 1 - sqrt(2 * (1 - p)) END"),
    ("normal", lambda: D.dnorm(_c("x")), "exp(-0.5 * x * x) / sqrt(2 * pi())", lambda: D.pnorm(_c("x")), _PNORM, lambda: D.pnorm(D.qnorm(_c("p"))), "p"),
    ("lognormal", lambda: D.dlnorm(F.exp(_c("x"))), "exp(-0.5 * x * x) / sqrt(2 * pi()) / exp(x)", lambda: D.plnorm(F.exp(_c("x"))), _PNORM, lambda: D.plnorm(D.qlnorm(_c("p"))), "p"),
):
    add(
        f"distribution_{_name}",
        lambda s, d, c=(_d, _p, _qq): rounded(_grid(s, d).select("q", c[0]().cast("double").alias("density"), c[1]().cast("double").alias("probability"), c[2]().cast("double").alias("quantile")), 8),
        _Z + f"SELECT q, round(({_dsql})::DOUBLE, 8) + 0.0::DOUBLE AS density, round(({_psql})::DOUBLE, 8) + 0.0::DOUBLE AS probability, round(({_qsql})::DOUBLE, 8) + 0.0::DOUBLE AS quantile FROM v",
    )
add(
    "distribution_gamma_beta",
    lambda s, d: rounded(_grid(s, d).select("q", D.dgamma(_c("q"), 2.5, 4.0).alias("gamma"), D.dbeta(_c("p"), 2.5, 1.5).alias("beta"), D.ddirichlet(F.array(_c("p") / 2, _c("p") / 2, 1 - _c("p")), [1.5, 2.0, 2.5]).alias("dirichlet"), D.dunifsimplex(F.array(_c("p"), 1 - _c("p"), F.lit(0.0)), 3).alias("simplex")), 8),
    _Z + """SELECT q, round(exp(1.5 * ln(q) - q / 4 - 2.5 * ln(4) - lgamma(2.5)), 8) AS gamma, round(exp(1.5 * ln(p) + 0.5 * ln(1 - p) + lgamma(4) - lgamma(2.5) - lgamma(1.5)), 8) AS beta,
round(exp(lgamma(6) - lgamma(1.5) - lgamma(2) - lgamma(2.5) + 0.5 * ln(p / 2) + ln(p / 2) + 1.5 * ln(1 - p)), 8) AS dirichlet, 2.0::DOUBLE AS simplex FROM v""",
)
add(
    "normal_quantile_approximations",
    lambda s, d: rounded(
        _grid(s, d).select(
            "q",
            *[
                (F.abs(f(_c("p")) - D.qnorm(_c("p"))) < tol).alias(n)
                for n, f, tol in (
                    ("acklam", D.qnorm_acklam, 1e-6), ("odeh_evans", D.qnorm_odeh_evans, 1e-6), ("beasley_springer", D.qnorm_beasley_springer, 1e-6),
                    ("hastings_67", D.qnorm_hastings_67, 4e-3), ("hastings_68", D.qnorm_hastings_68, 5e-4), ("hill_davis", D.qnorm_hill_davis, 1e-3),
                    ("bailey", D.qnorm_bailey, 1e-2), ("koehler", D.qnorm_koehler, 2e-2),
                )
            ],
        )
    ),
    _Z + "SELECT q, true AS acklam, true AS odeh_evans, true AS beasley_springer, true AS hastings_67, true AS hastings_68, true AS hill_davis, true AS bailey, true AS koehler FROM v",
)


def _draws(s: SparkSession, d: str) -> DataFrame:
    k = "event_id"
    dirichlet, simplex = D.rdirichlet([1.0, 2.0], 17, k), D.runifsimplex(3, 18, k)
    # a file may have few parts, and a row takes long: dealt out by numbers of rows
    events = table(s, d, "events").select(k)
    events = events.repartition(max(1, min(2000, -(-events.count() // 20_000))))
    # arrays are columns of their own first, so that each is drawn once
    drawn = events.select(k, dirichlet.alias("dirichlet"), simplex.alias("simplex"))
    return rounded(
        drawn.select(
            k, D.rbern(0.3, 1, k).alias("bernoulli"), D.rbinom(20, 0.4, 2, k).alias("binomial"), D.rgeom(0.2, 3, k).alias("geometric"), D.rhyper(6, 7, 5, 4, k).alias("hypergeometric"),
            D.rpois(3.0, 5, k).alias("poisson"), D.runif(1, 3, 6, k).alias("uniform"), D.rexp(2.0, 7, k).alias("exponential"), D.rlaplace(0, 1, 8, k).alias("laplace"), D.rlogis(0, 1, 9, k).alias("logistic"),
            D.pcauchy(D.rcauchy(0, 1, 10, k), 0, 1).alias("cauchy_share"), bound(D.rcos(0, 1, 11, k), lambda x: D.pcos(x, 0, 1)).alias("raised_cosine_share"), D.rtriang(0, 1, 12, k).alias("triangular"), D.rnorm(0, 1, 13, k).alias("normal"), D.rlnorm(0, 1, 14, k).alias("lognormal"),
            D.rgamma(2.0, 1.5, 15, k).alias("gamma"), D.rbeta(2.0, 3.0, 16, k).alias("beta"), *[F.get("dirichlet", i).alias(f"dirichlet_{i}") for i in range(2)], *[F.get("simplex", i).alias(f"simplex_{i}") for i in range(3)],
        )
    )


def _draws_sql() -> str:
    k = "event_id"
    u = {n: fits_sql.uniform(n, k) for n in range(1, 15)}
    z = {n: fits_sql.normal(n, k) for n in (13, 14)}
    g = {n: fits_sql.gamma(a, n, k) for n, a in ((15, 2.0), (32, 2.0), (33, 3.0), (527, 1.0), (528, 2.0))}
    e = [f"(-ln(1 - {fits_sql.uniform(18 * 31 + i, k)}))" for i in range(3)]
    binomial = [math.comb(20, i) * 0.4**i * 0.6 ** (20 - i) for i in range(21)]
    hyper = [math.comb(6, i) * math.comb(7, 5 - i) / math.comb(13, 5) for i in range(6)]
    poisson = [math.exp(-3) * 3**i / math.factorial(i) for i in range(40)]
    columns = {
        "bernoulli": f"({u[1]} < 0.3::DOUBLE)::INT", "binomial": fits_sql.first_above(u[2], binomial), "geometric": f"greatest(0, ceil(ln(1 - {u[3]}) / ln(0.8::DOUBLE) - 1 - 1e-12))",
        "hypergeometric": fits_sql.first_above(u[4], hyper), "poisson": fits_sql.first_above(u[5], poisson), "uniform": f"1 + 2 * {u[6]}", "exponential": f"-ln(1 - {u[7]}) / 2",
        "laplace": f"-0.5::DOUBLE * sign({u[8]} - 0.5::DOUBLE) * ln(1 - 2 * abs({u[8]} - 0.5::DOUBLE))", "logistic": f"ln({u[9]} / (1 - {u[9]}))", "cauchy_share": u[10], "raised_cosine_share": u[11],
        "triangular": f"CASE WHEN {u[12]} < 0.5 THEN sqrt(2 * {u[12]}) - 1 ELSE 1 - sqrt(2 * (1 - {u[12]})) END", "normal": z[13], "lognormal": f"exp({z[14]})", "gamma": f"1.5::DOUBLE * {g[15]}",
        "beta": f"{g[32]} / ({g[32]} + {g[33]})", "dirichlet_0": f"{g[527]} / ({g[527]} + {g[528]})", "dirichlet_1": f"{g[528]} / ({g[527]} + {g[528]})", **{f"simplex_{i}": f"{x} / ({' + '.join(e)})" for i, x in enumerate(e)},
    }
    whole = ("bernoulli",)
    return f"SELECT {k}, " + ", ".join(f"{x} AS {n}" if n in whole else f"round({x}, 6) + 0.0::DOUBLE AS {n}" for n, x in columns.items()) + " FROM events"


add("distribution_draws", _draws, _draws_sql())

# Special functions.

add(
    "special_functions",
    lambda s, d: rounded(
        _grid(s, d).select(
            "q",
            F.log(special.factorial(_c("q"))).alias("log_factorial"), (special.stirling(_c("q")) / special.factorial(_c("q"))).alias("stirling"), (special.gosper(_c("q")) / special.factorial(_c("q"))).alias("gosper"),
            special.log_beta(_c("q"), 2.5).alias("log_beta"), F.log(special.binom_coefficient(60, _c("q"))).alias("log_binom"), log_gamma(_c("p")).alias("log_gamma"), erf(_c("x")).alias("erf"),
            special.deriv1(F.exp, _c("p")).alias("slope"), special.deriv2(F.exp, _c("p"), 1e-3).alias("curve"), special.deriv(F.sin, _c("p"), 3).alias("third"),
            special.cubic_basis(_c("x"), 0.3).alias("cubic"), special.bernstein_poly(_c("p"), lambda t: t * t, 10).alias("bernstein"),
            special.eval_poly(_c("p"), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))).alias("poly"), special.hard_clip(_c("x"), 0.5).alias("hard"), special.soft_clip(_c("x"), 0.5).alias("soft"),
            special.jl_dimension(0.2, _c("q") + 1).alias("jl_dim"), special.jl_epsilon(100, _c("q") + 1).alias("jl_eps"),
        ),
        3,
    ),
    _Z + f"""SELECT q, round(lgamma(q + 1), 3) AS log_factorial, round(sqrt(2 * pi() * q) * pow(q / exp(1), q) / exp(lgamma(q + 1)), 3) AS stirling, round(sqrt((2 * q + 1.0::DOUBLE / 3) * pi()) * pow(q / exp(1), q) / exp(lgamma(q + 1)), 3) AS gosper,
round(lgamma(q) + lgamma(2.5) - lgamma(q + 2.5), 3) AS log_beta, round({_LOGC.format('60', 'q')}, 3) AS log_binom, round(lgamma(p), 3) AS log_gamma, round({_ERF.format('x')}, 3) + 0.0::DOUBLE AS erf,
round(exp(p), 3) AS slope, round(exp(p), 3) AS curve, round(-cos(p), 3) + 0.0::DOUBLE AS third, round(pow(greatest(0, x - 0.3), 3), 3) AS cubic, round(p * p + p * (1 - p) / 10, 3) AS bernstein,
round(1 + p + p * p / 2, 3) AS poly, round(least(0.5, greatest(-0.5, x)), 3) + 0.0::DOUBLE AS hard, round(0.5 * tanh(x / 0.5), 3) + 0.0::DOUBLE AS soft, ceil(8 * ln(q + 1) / (0.2::DOUBLE * 0.2))::BIGINT AS jl_dim, round(sqrt(8 * ln(q + 1) / 100), 3) AS jl_eps FROM v""",
)
add(
    "series_expansions",
    lambda s, d: rounded(
        _grid(s, d).select(
            "q",
            special.eval_power_series(_c("p"), special.maclaurin_coefficients(math.exp, 4)).alias("maclaurin"),
            special.eval_power_series(_c("p"), special.taylor_coefficients(math.exp, 4, 0.5), 0.5).alias("taylor"),
            special.eval_fourier(_c("x"), special.fourier_coefficients(lambda t: t * t, 5)).alias("fourier"),
            sum((special.bspline_basis(_c("p"), i, 4, [0, 0, 0, 0, 0.5, 1, 1, 1, 1]) for i in range(5)), F.lit(0.0)).alias("bspline_unity"),
            special.bspline_basis(_c("p"), 0, 2, [0, 0.5, 1]).alias("bspline_linear"),
        ),
        3,
    ),
    _Z + """SELECT q, round(1 + p + p * p / 2 + pow(p, 3) / 6 + pow(p, 4) / 24, 3) AS maclaurin,
round(exp(0.5) * (1 + (p - 0.5) + pow(p - 0.5, 2) / 2 + pow(p - 0.5, 3) / 6 + pow(p - 0.5, 4) / 24), 3) AS taylor,
round(pi() * pi() / 3 + list_sum(list_transform(range(1, 6), lambda k: 4 * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * cos(k * x) / (k * k))), 3) AS fourier,
1.0::DOUBLE AS bspline_unity, round(CASE WHEN p < 0.5 THEN p / 0.5 ELSE (1 - p) / 0.5 END, 3) AS bspline_linear FROM v""",
)

# Linear models.


def _coefficients(s: SparkSession, beta: np.ndarray, digits: int = 6) -> DataFrame:
    return rounded(s.createDataFrame([(i, float(b)) for i, b in enumerate(beta)], "term int, coefficient double"), digits)




def _one() -> Column:
    return F.lit(1.0)


def _step_x() -> Column:
    return (F.col("l_quantity") - 25) / 25


def _step_y() -> Column:
    return (F.col("l_extendedprice") > 40000).cast("double")


add(
    "ols",
    lambda s, d: _coefficients(s, glm.ols(table(s, d, "lineitem"), "l_extendedprice", [_one(), _q]).coefficients, 3),
    "SELECT 0 AS term, round(regr_intercept(l_extendedprice, l_quantity), 3) AS coefficient FROM lineitem UNION ALL SELECT 1, round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem",
)
_TWO = "WITH s AS (SELECT sum({w} * l_quantity * l_quantity) a, sum({w} * l_quantity * l_discount) b, sum({w} * l_discount * l_discount) c, sum({w} * l_quantity * l_extendedprice) u, sum({w} * l_discount * l_extendedprice) v FROM lineitem) "
_TWO_COEF = "SELECT 0 AS term, round((c * u - b * v) / (a * c - b * b), 3) AS coefficient FROM s UNION ALL SELECT 1, round((a * v - b * u) / (a * c - b * b), 3) FROM s"
add("ols_two_predictors", lambda s, d: _coefficients(s, glm.ols(table(s, d, "lineitem"), "l_extendedprice", [_q, "l_discount"]).coefficients, 3), _TWO.format(w="1") + _TWO_COEF)
add("wls", lambda s, d: _coefficients(s, glm.ols(table(s, d, "lineitem"), "l_extendedprice", [_q, "l_discount"], F.col("l_tax") + 0.5).coefficients, 3), _TWO.format(w="(l_tax + 0.5::DOUBLE)") + _TWO_COEF)


def _residuals(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem")
    fit = glm.ols(rows, "l_extendedprice", [_one(), _q])
    return rounded(glm.residuals(rows, "l_extendedprice", [_one(), _q], fit).select("l_orderkey", "l_linenumber", "residual"), 3)


add(
    "ols_residuals",
    _residuals,
    """WITH k AS (SELECT regr_intercept(l_extendedprice, l_quantity) a, regr_slope(l_extendedprice, l_quantity) b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_extendedprice - a - b * l_quantity, 3) + 0.0::DOUBLE AS residual FROM lineitem, k""",
)
add(
    "ols_coefficient_covariance",
    lambda s, d: rounded(linear.matrix_frame(s, glm.coefficient_covariance(table(s, d, "lineitem"), "l_extendedprice", [_one(), _q])), 3),
    """WITH k AS (SELECT count(*) n, sum(l_quantity) sx, sum(l_quantity * l_quantity) sxx, regr_intercept(l_extendedprice, l_quantity) a, regr_slope(l_extendedprice, l_quantity) b FROM lineitem),
r AS (SELECT sum(pow(l_extendedprice - a - b * l_quantity, 2)) / (any_value(n) - 2) s2 FROM lineitem, k), d AS (SELECT s2, n, sx, sxx, n * sxx - sx * sx det FROM k, r)
SELECT 0 AS i, 0 AS j, round(s2 * sxx / det, 3) AS v FROM d UNION ALL SELECT 0, 1, round(-s2 * sx / det, 3) FROM d UNION ALL SELECT 1, 0, round(-s2 * sx / det, 3) FROM d UNION ALL SELECT 1, 1, round(s2 * n / det, 3) FROM d""",
)
add(
    "logit",
    lambda s, d: _coefficients(s, glm.logit(table(s, d, "lineitem"), _step_y(), [_one(), _step_x()], 10).coefficients, 5),
    fits_sql.newton("SELECT (l_quantity - 25) / 25 x, (l_extendedprice > 40000)::INT::DOUBLE y FROM lineitem", "4 * y - 2", "1 / (1 + exp(-e_))", "m * (1 - m)", 10),
)
for _family, _curve in (("poisson", "m"), ("gamma", "m * m"), ("negative_binomial", "m + m * m"), ("inverse_gaussian", "m * m * m")):
    add(
        f"log_link_{_family}",
        lambda s, d, f=_family: _coefficients(s, glm.log_link(table(s, d, "lineitem"), F.col("l_extendedprice") / 40000 + 0.5, [_one(), F.col("l_quantity") / 50], f, 30).coefficients, 5),
        fits_sql.newton("SELECT l_quantity / 50 x, l_extendedprice / 40000 + 0.5::DOUBLE y FROM lineitem", "CASE WHEN y > 1 THEN ln(y) ELSE y - 1 END", "exp(e_)", _curve, 30),
    )
add(
    "least_absolute",
    lambda s, d: _coefficients(s, glm.least_absolute(table(s, d, "lineitem"), F.col("l_extendedprice") / 1000, [_one(), _step_x()], None, 10).coefficients, 3),
    fits_sql.least_absolute("SELECT (l_quantity - 25) / 25 x, l_extendedprice / 1000 y, 1.0::DOUBLE w0 FROM lineitem", 10, 3),
)
add(
    "least_absolute_weighted",
    lambda s, d: _coefficients(s, glm.least_absolute(table(s, d, "lineitem"), F.col("l_extendedprice") / 1000, [_one(), _step_x()], F.col("l_tax") + 0.5, 10).coefficients, 3),
    fits_sql.least_absolute("SELECT (l_quantity - 25) / 25 x, l_extendedprice / 1000 y, l_tax + 0.5::DOUBLE w0 FROM lineitem", 10, 3),
)
add("forward_stagewise", lambda s, d: _coefficients(s, glm.forward_stagewise(table(s, d, "lineitem"), F.col("l_extendedprice") / 1000, [_step_x(), "l_discount", "l_tax"], 30.0).coefficients, 5))
add("forward_stagewise_bic", lambda s, d: _coefficients(s, glm.forward_stagewise(table(s, d, "lineitem"), F.col("l_extendedprice") / 1000, [_step_x(), "l_discount", "l_tax"]).coefficients, 5))


def _capture(n_lists: int) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = table(s, d, "customer").select(
            ((F.col("c_acctbal") - 4500) / 5500).alias("x"), *[(uniform(i, "c_custkey") < 0.6 - 0.1 * i).cast("double").alias(f"y{i}") for i in range(n_lists)]
        )
        lists = [(f"y{i}", [_one(), F.col("x")]) for i in range(n_lists)]
        betas = glm.capture_recapture(rows, lists, 40, 0.05)
        out = glm.population_size(rows, lists, betas)
        return rounded(out, 3)

    return run


for _name, _n in (("two", 2), ("three", 3)):
    _on = ", ".join(f"({fits_sql.uniform(i, 'c_custkey')} < {0.6 - 0.1 * i!r}::DOUBLE)::INT::DOUBLE y{i}" for i in range(_n))
    add(f"capture_recapture_{_name}", _capture(_n), fits_sql.capture_recapture(f"SELECT (c_acctbal - 4500) / 5500 x, {_on} FROM customer", _n, 40, 0.05, 0.01))

# Linear algebra.

_XS = ["l_quantity", "l_discount", "l_tax"]


def _gram_sql(scale: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum({a} * {b}){scale}, 4) AS v FROM lineitem" for i, a in enumerate(_XS) for j, b in enumerate(_XS))


add("gram", lambda s, d: rounded(linear.matrix_frame(s, linear.gram(table(s, d, "lineitem"), _XS)), 4), _gram_sql())
add(
    "covariance",
    lambda s, d: rounded(linear.matrix_frame(s, linear.covariance(table(s, d, "lineitem"), _XS)), 6),
    " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_pop({a}, {b}), 6) + 0.0::DOUBLE AS v FROM lineitem" for i, a in enumerate(_XS) for j, b in enumerate(_XS)),
)
add(
    "covariance_inverse",
    lambda s, d: rounded(linear.matrix_frame(s, linear.inverse_symmetric(linear.covariance(table(s, d, "lineitem"), _XS[:2]))), 4),
    """WITH k AS (SELECT var_pop(l_quantity) a, covar_pop(l_quantity, l_discount) b, var_pop(l_discount) c FROM lineitem)
SELECT 0 AS i, 0 AS j, round(c / (a * c - b * b), 4) AS v FROM k UNION ALL SELECT 0, 1, round(-b / (a * c - b * b), 4) + 0.0::DOUBLE FROM k UNION ALL SELECT 1, 0, round(-b / (a * c - b * b), 4) + 0.0::DOUBLE FROM k UNION ALL SELECT 1, 1, round(a / (a * c - b * b), 4) FROM k""",
)
add(
    "correlation_inverse",
    lambda s, d: rounded(linear.matrix_frame(s, linear.inverse_symmetric(linear.correlation(table(s, d, "lineitem"), _XS[:2]))), 6),
    """WITH k AS (SELECT corr(l_quantity, l_discount) r FROM lineitem)
SELECT 0 AS i, 0 AS j, round(1 / (1 - r * r), 6) AS v FROM k UNION ALL SELECT 0, 1, round(-r / (1 - r * r), 6) + 0.0::DOUBLE FROM k UNION ALL SELECT 1, 0, round(-r / (1 - r * r), 6) + 0.0::DOUBLE FROM k UNION ALL SELECT 1, 1, round(1 / (1 - r * r), 6) FROM k""",
)
add(
    "qr_r",
    lambda s, d: rounded(linear.matrix_frame(s, linear.qr_r(table(s, d, "lineitem"), _XS[:2])), 4),
    """WITH k AS (SELECT sum(l_quantity * l_quantity) a, sum(l_quantity * l_discount) b, sum(l_discount * l_discount) c FROM lineitem)
SELECT 0 AS i, 0 AS j, round(sqrt(a), 4) AS v FROM k UNION ALL SELECT 0, 1, round(b / sqrt(a), 4) FROM k UNION ALL SELECT 1, 0, 0.0::DOUBLE FROM k UNION ALL SELECT 1, 1, round(sqrt(c - b * b / a), 4) FROM k""",
)
def _tall_q(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *_XS[:2])
    return rounded(linear.tall_skinny_qr(rows, _XS[:2])[0].select("l_orderkey", "l_linenumber", "q0", "q1"), 8)


add(
    "qr_tall_skinny",
    _tall_q,
    """WITH k AS (SELECT sum(l_quantity * l_quantity) a, sum(l_quantity * l_discount) b, sum(l_discount * l_discount) c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_quantity / sqrt(a), 8) AS q0, round((l_discount - l_quantity * b / a) / sqrt(c - b * b / a), 8) + 0.0::DOUBLE AS q1 FROM lineitem, k""",
)
add(
    "qr_q",
    lambda s, d: rounded(linear.qr_q(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *_XS[:2]), _XS[:2]).select("l_orderkey", "l_linenumber", "q0", "q1"), 8),
    """WITH k AS (SELECT sum(l_quantity * l_quantity) a, sum(l_quantity * l_discount) b, sum(l_discount * l_discount) c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_quantity / sqrt(a), 8) AS q0, round((l_discount - l_quantity * b / a) / sqrt(c - b * b / a), 8) + 0.0::DOUBLE AS q1 FROM lineitem, k""",
)
add(
    "outer_product",
    lambda s, d: rounded(linear.outer_product(table(s, d, "part"), "p_partkey", ["p_size", "p_retailprice"], table(s, d, "part").where("p_partkey % 20 = 0")), 2),
    "SELECT a.p_partkey, b.p_partkey AS query, round(a.p_size * b.p_size + a.p_retailprice * b.p_retailprice, 2) AS v FROM part a, part b WHERE b.p_partkey % 20 = 0",
)


def _spectral(s: SparkSession, d: str) -> DataFrame:
    c = linear.correlation(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(s.createDataFrame([(i, float(v)) for i, v in enumerate(linear.dominant_eigenvector(c))], "i int, v double"))


add("dominant_eigenvector", _spectral, "SELECT i::INT AS i, round(1 / sqrt(2), 6) AS v FROM range(0, 2) t(i)")
add(
    "determinants",
    lambda s, d: rounded(s.createDataFrame([(linear.determinant(linear.correlation(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"])), linear.log_determinant(linear.correlation(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"])))], "det double, logdet double")),
    "SELECT round(1 - pow(corr(l_quantity, l_extendedprice), 2), 6) AS det, round(ln(1 - pow(corr(l_quantity, l_extendedprice), 2)), 6) AS logdet FROM lineitem",
)

# Series.

_DAY = "WITH t AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS \"day\", sum(o_totalprice) x FROM orders GROUP BY 1) "


def _daily(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp").alias("day")).agg(F.sum("o_totalprice").alias("x"))


def _epoch(df: DataFrame) -> DataFrame:
    return df.select(F.unix_date(F.to_date("day")).cast("long").alias("day"), *[c for c in df.columns if c != "day"])


_DAYN = _DAY.replace("date_trunc('day', o_orderdate)::TIMESTAMP", "date_diff('day', DATE '1970-01-01', o_orderdate::DATE)")
for _dd, _sql in ((1, "lead(x) OVER w - x"), (2, "lead(x, 2) OVER w - 2 * lead(x) OVER w + x")):
    add(
        f"difference_{_dd}",
        lambda s, d, k=_dd: rounded(timeseries.difference(_epoch(_daily(s, d)), "x", "day", k), 2),
        _DAYN + f"SELECT * FROM (SELECT \"day\", round({_sql}, 2) AS diff FROM t WINDOW w AS (ORDER BY \"day\")) WHERE diff IS NOT NULL",
    )
add(
    "difference_reference",
    lambda s, d: rounded(timeseries.difference(_epoch(_daily(s, d)), "x", "day", 1, "reference"), 2),
    _DAYN + 'SELECT * FROM (SELECT "day", round(x - lead(x) OVER (ORDER BY "day"), 2) AS diff FROM t) WHERE diff IS NOT NULL',
)
add(
    "lag_matrix",
    lambda s, d: rounded(timeseries.lag_matrix(_epoch(_daily(s, d)), "x", "day", 3), 2),
    _DAYN + 'SELECT * FROM (SELECT "day", round(x, 2) AS target, round(lag(x) OVER w, 2) AS lag1, round(lag(x, 2) OVER w, 2) AS lag2, round(lag(x, 3) OVER w, 2) AS lag3 FROM t WINDOW w AS (ORDER BY "day")) WHERE lag3 IS NOT NULL',
)
add(
    "ar_1",
    lambda s, d: _coefficients(s, timeseries.fit_ar(_epoch(_daily(s, d)), "x", "day", 1).ar),
    _DAYN + ', c AS (SELECT "day", x - (SELECT avg(x) FROM t) z FROM t), l AS (SELECT z, lag(z) OVER (ORDER BY "day") y FROM c) SELECT 0 AS term, round(sum(z * y) / sum(y * y), 6) + 0.0::DOUBLE AS coefficient FROM l WHERE y IS NOT NULL',
)
add("ar_3", lambda s, d: _coefficients(s, timeseries.fit_ar(_epoch(_daily(s, d)), "x", "day", 3).ar), fits_sql.three_lags(_DAYN))
add(
    "ma_1",
    lambda s, d: _coefficients(s, timeseries.fit_ma(_epoch(_daily(s, d)), "x", "day", 1, 4).ma, 4),
    _DAYN + ", c AS (SELECT \"day\", x - (SELECT avg(x) FROM t) z FROM t), " + ", ".join(fits_sql.moving_average("c", 4)) + " SELECT 0 AS term, round(q, 4) + 0.0::DOUBLE AS coefficient FROM h4",
)


def _arma(s: SparkSession, d: str) -> DataFrame:
    fit = timeseries.fit_arma(_epoch(_daily(s, d)), "x", "day", 1, 1)
    return _coefficients(s, np.concatenate([fit.ar, fit.ma]), 4)


add(
    "arma_1_1",
    _arma,
    _DAYN
    + """, k AS (SELECT "day", x - (SELECT avg(x) FROM t) z FROM t), y AS (SELECT "day", z, lag(z) OVER (ORDER BY "day") y FROM k),
a AS MATERIALIZED (SELECT sum(z * y) / sum(y * y) p FROM y WHERE y IS NOT NULL), u AS (SELECT "day", z - p * y e FROM y, a WHERE y IS NOT NULL), c AS (SELECT "day", e - (SELECT avg(e) FROM u) z FROM u), """
    + ", ".join(fits_sql.moving_average("c", 20))
    + " SELECT 0 AS term, round(p, 4) + 0.0::DOUBLE AS coefficient FROM a UNION ALL SELECT 1, round(q, 4) + 0.0::DOUBLE FROM h20",
)

# Neighbours, smoothers, rank distances.


def _search(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"), (F.col("label") + 1).cast("double").alias("w"))
    return e.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("x").alias("q")), e


_NN = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) x FROM embeddings),
d AS (SELECT a.vec_id AS query, b.vec_id AS id, b.label::DOUBLE y, b.label + 1 w, {} AS distance FROM e a, e b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d) """
_L2 = "sqrt(list_sum(list_transform(list_zip(b.x, a.x), lambda t: pow(t[1] - t[2], 2))))"
_L1 = "list_sum(list_transform(list_zip(b.x, a.x), lambda t: abs(t[1] - t[2])))"
_LI = "list_max(list_transform(list_zip(b.x, a.x), lambda t: abs(t[1] - t[2])))"
for _name, _metric, _sql in (("l1", distances.manhattan, _L1), ("l2", distances.euclidean, _L2), ("linf", distances.chebyshev, _LI)):
    add(
        f"knn_indices_{_name}",
        lambda s, d, m=_metric: rounded(neighbors.nearest(*_search(s, d), 5, m).select("query", "id", F.col("rank").cast("long").alias("rank"), "distance")),
        _NN.format(_sql) + "SELECT query, id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 5",
    )
for _name, _args, _w in (("", {}, "1"), ("_inverse_distance", {"alpha": 2.0}, "2 / (1 + pow(distance, 2))"), ("_weighted", {"weight": "w"}, "w"), ("_weighted_inverse_distance", {"alpha": 2.0, "weight": "w"}, "w * 2 / (1 + pow(distance, 2))")):
    add(
        f"knn_regression{_name}",
        lambda s, d, a=_args: rounded(neighbors.knn_regression(*_search(s, d), 5, distances.euclidean, **a)),
        _NN.format(_L2) + f"SELECT query, round(sum(({_w}) * y) / sum({_w}), 6) AS prediction FROM r WHERE rank <= 5 GROUP BY query",
    )
    add(
        f"knn_classification{_name}",
        lambda s, d, a=_args: neighbors.knn_classification(*_search(s, d), 5, distances.euclidean, **a),
        _NN.format(_L2) + f"SELECT query, arg_min(y, (-v, y)) AS prediction FROM (SELECT query, y, round(sum({_w.replace('2 / ', '1 / ')}), 9) v FROM r WHERE rank <= 5 GROUP BY 1, 2) GROUP BY query".replace("w * 2 / ", "w * 1 / "),
    )
add(
    "nearest_one",
    lambda s, d: rounded(neighbors.nearest_one(*_search(s, d), distances.euclidean)),
    _NN.format(_L2) + "SELECT query, id, round(distance, 6) AS distance FROM r WHERE rank = 1",
)


def _series(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return c.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("query"), F.col("x").alias("q")), c


_SM = """WITH c AS (SELECT c_custkey, c_acctbal / 1000 x, c_nationkey::DOUBLE y FROM customer),
d AS (SELECT a.c_custkey AS query, b.x - a.x z, b.y, exp(-0.5 * pow((b.x - a.x) / 0.8, 2)) / sqrt(2 * pi()) k FROM c a, c b WHERE a.c_custkey % 20 = 0) """


def _local_average(s: SparkSession, d: str) -> DataFrame:
    q, r = _series(s, d)
    return rounded(neighbors.local_average(q.withColumn("q", F.array("q")), r.withColumn("x", F.array("x")), kernels.gaussian, 0.8))


add("local_average", _local_average, _SM + "SELECT query, round(sum(k * y) / sum(k), 6) AS prediction FROM d GROUP BY query")
add(
    "local_linear",
    lambda s, d: rounded(neighbors.local_linear(*_series(s, d), kernels.gaussian, 0.8), 5),
    _SM + "SELECT query, round((sum(k * z * z) * sum(k * y) - sum(k * z) * sum(k * z * y)) / (sum(k) * sum(k * z * z) - pow(sum(k * z), 2)), 5) AS prediction FROM d GROUP BY query",
)
_BAND = """WITH r AS (SELECT l_extendedprice x, l_quantity y FROM lineitem), q AS (SELECT c_custkey AS query, c_acctbal * 10 q FROM customer WHERE c_custkey % 20 = 0),
d AS (SELECT query, x - q z, y, 0.75::DOUBLE * (1 - pow((x - q) / 500.0::DOUBLE, 2)) k FROM r, q WHERE abs(x - q) <= 500) """


def _band(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = table(s, d, "customer").where(F.pmod("c_custkey", F.lit(20)) == 0).select(F.col("c_custkey").alias("query"), (F.col("c_acctbal") * 10).alias("q"))
    return q, table(s, d, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").cast("double").alias("y"))


def _band_average(s: SparkSession, d: str) -> DataFrame:
    q, r = _band(s, d)
    return rounded(neighbors.local_average(q.withColumn("q", F.array("q")), r.withColumn("x", F.array("x")), kernels.epanechnikov, 500.0, compact=True))


add("local_average_band", _band_average, _BAND + "SELECT query, round(sum(k * y) / sum(k), 6) AS prediction FROM d GROUP BY query")
add(
    "local_linear_band",
    lambda s, d: rounded(neighbors.local_linear(*_band(s, d), kernels.epanechnikov, 500.0, compact=True), 5),
    _BAND + "SELECT query, round((sum(k * z * z) * sum(k * y) - sum(k * z) * sum(k * z * y)) / nullif(sum(k) * sum(k * z * z) - pow(sum(k * z), 2), 0), 5) AS prediction FROM d GROUP BY query",
)
add(
    "lagrange",
    lambda s, d: rounded(neighbors.lagrange(table(s, d, "nation").select(F.col("n_nationkey").alias("query"), (F.col("n_nationkey") / 25).alias("q")), table(s, d, "region").select(((F.col("r_regionkey") - 2) / 2).alias("x"), F.exp((F.col("r_regionkey") - 2) / 2).alias("y")))),
    """WITH n AS (SELECT (r_regionkey - 2) / 2 x, exp((r_regionkey - 2) / 2) y FROM region), q AS (SELECT n_nationkey AS query, n_nationkey / 25 q FROM nation),
l AS (SELECT query, a.x, a.y, product((q - b.x) / (a.x - b.x)) l FROM q, n a, n b WHERE a.x <> b.x GROUP BY ALL)
SELECT query, round(sum(y * l), 6) AS value FROM l GROUP BY query""",
)
for _mode, _sql in (("standard", "(1 - tau) / 2"), ("reference", "1 - 2 * tau")):
    add(
        f"kendall_{_mode}",
        lambda s, d, m=_mode: rounded(neighbors.kendall_distance(table(s, d, "lineitem"), "l_quantity", "l_discount", m)),
        f"""WITH c AS (SELECT l_quantity x, l_discount y, count(*) c FROM lineitem GROUP BY 1, 2), n AS (SELECT count(*)::DOUBLE n FROM lineitem),
p AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.c * b.c)::DOUBLE s FROM c a, c b WHERE a.x > b.x), k AS (SELECT s * 2 / (n * (n - 1)) tau FROM p, n)
SELECT round({_sql}, 6) AS kendall FROM k""",
    )
for _mode, _sql in (("standard", "1 - rho"), ("reference", "rho")):
    add(
        f"spearman_{_mode}",
        lambda s, d, m=_mode: rounded(neighbors.spearman_distance(table(s, d, "customer"), "c_custkey", "c_acctbal", "c_nationkey", m)),
        f"""WITH r AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) a, row_number() OVER (ORDER BY c_nationkey, c_custkey) b FROM customer),
k AS (SELECT 1 - 6 * sum(pow(a - b, 2)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*)::DOUBLE - 1)) rho FROM r) SELECT round({_sql}, 6) + 0.0::DOUBLE AS spearman FROM k""",
    )
add(
    "distance_variance_bounds",
    lambda s, d: rounded(table(s, d, "lineitem").agg(neighbors.distance_variance_bounds([_q, "l_tax"], 0.1).alias("b")).select(F.get("b", 0).alias("lower"), F.get("b", 1).alias("upper"))),
    "SELECT round(0.9::DOUBLE * (var_pop(l_quantity) + var_pop(l_tax)), 6) AS lower, round(1.1::DOUBLE * (var_pop(l_quantity) + var_pop(l_tax)), 6) AS upper FROM lineitem",
)

# Clusters, forests, trees, nets.


def _points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))


def _indexed(s: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every twentieth, exactly, through the metric tree."""
    p = _points(s, d).select(F.col("vec_id").alias("id"), "x")
    index = metric_index.build_index(p, distances.euclidean)
    queries = p.where(F.pmod("id", F.lit(20)) == 0).select(F.col("id").alias("query"), F.col("x").alias("q"))
    return rounded(metric_index.nearest_indexed(index, queries, 5, distances.euclidean), 5)


add(
    "nearest_index",
    _indexed,
    """WITH p AS (SELECT vec_id, embedding::DOUBLE[] x FROM embeddings), d AS (SELECT q.vec_id AS query, p.vec_id AS id, list_distance(p.x, q.x) AS distance FROM p, p q WHERE q.vec_id % 20 = 0)
SELECT query, id, round(distance, 5) + 0.0::DOUBLE AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, id)::INT AS rank FROM d QUALIFY rank <= 5""",
)


def _index_recall(s: SparkSession, d: str) -> DataFrame:
    """Recall of the ten nearest by 180 probes a level, with the share of distances."""
    p = _points(s, d).select(F.col("vec_id").alias("id"), "x")
    # two levels at every size: 180 probes stay one share of the leaves, and so does the recall
    index = metric_index.build_index(p, distances.euclidean, branch=16, leaf=max(8, -(-p.count() // 250)))
    queries = p.where(F.pmod("id", F.lit(20)) == 0).select(F.col("id").alias("query"), F.col("x").alias("q"))
    found = metric_index.nearest_indexed(index, queries, 10, distances.euclidean, probe=180)
    exact = metric_index.nearest_indexed(index, queries, 10, distances.euclidean)
    one = metric_index.recall(found, exact).crossJoin(metric_index.search_work(index, queries, 10, distances.euclidean, 180))  # one row each
    return rounded(one.crossJoin(metric_index.search_work(index, queries, 10, distances.euclidean).toDF("computed_exact", "share_exact")), 4)


add("nearest_index_recall", _index_recall)


def _kmeans(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    c = cluster.k_means(p, "x", 2, 2, [[-0.1] * 64, [0.1] * 64])
    return cluster.assign(p, "x", c).select("vec_id", F.col("cluster").cast("long").alias("cluster"))


_NEAR = "CASE WHEN list_sum(list_transform(list_zip(x, c0), lambda t: pow(t[1] - t[2], 2))) <= list_sum(list_transform(list_zip(x, c1), lambda t: pow(t[1] - t[2], 2))) THEN 0 ELSE 1 END"
_MEANS = "SELECT " + ", ".join(f"(SELECT list(v ORDER BY i) FROM (SELECT i, avg(x[i]) v FROM {{0}}, range(1, 65) r(i) WHERE c = {k} GROUP BY i)) c{k}" for k in (0, 1))
add(
    "k_means",
    _kmeans,
    f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) x FROM embeddings), m0 AS (SELECT list_transform(range(64), lambda i: -0.1::DOUBLE) c0, list_transform(range(64), lambda i: 0.1::DOUBLE) c1),
s1 AS MATERIALIZED (SELECT x, {_NEAR} c FROM e, m0), m1 AS MATERIALIZED ({_MEANS.format('s1')}), s2 AS MATERIALIZED (SELECT x, {_NEAR} c FROM e, m1), m2 AS MATERIALIZED ({_MEANS.format('s2')})
SELECT vec_id, ({_NEAR})::BIGINT AS cluster FROM e, m2""",
)
for _name, _kind, _how in (
    ("isolation_forest", "projection", "mean_depth"), ("isolation_forest_enhanced", "projection", "mean_score"), ("isolation_forest_gap", "gap", "mean_score"), ("isolation_forest_fuzzy", "gap", "conorm"),
    ("isolation_forest_deep", "deep", "mean_depth"), ("isolation_forest_proximity_one", "prototype", "conorm"), ("isolation_forest_proximity_two", "steinhaus", "conorm"),
):

    def _iso(s: SparkSession, d: str, kind: str = _kind, how: str = _how) -> DataFrame:
        p = _points(s, d)
        return rounded(iforest.anomaly_scores(p, "vec_id", "x", iforest.isolation_forest(p, "vec_id", "x", 25, 32, kind), how))

    add(_name, _iso)


def _part_metric(x: pa.StructArray, p: dict) -> np.ndarray:
    """Difference in size over 50, and one for another brand."""
    brand = x.field("brand")
    other = brand.is_valid() if p["brand"] is None else pc.fill_null(pc.not_equal(brand, p["brand"]), True)
    return np.abs(x.field("size").to_numpy(zero_copy_only=False) - p["size"]) / 50 + other.to_numpy(zero_copy_only=False)


def _parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("x"))


for _name, _kind in (("proximity_records_one", "one"), ("proximity_records_two", "two")):

    def _proximity(s: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        p = _parts(s, d)
        forest = records.proximity_forest(p, "p_partkey", "x", _part_metric, 25, 30, kind, 4)
        return rounded(records.proximity_scores(p, "p_partkey", "x", forest, _part_metric))

    add(_name, _proximity)


def _record_mean(s: SparkSession, d: str) -> DataFrame:
    p = _parts(s, d)
    mean, value = records.record_mean(p, "x", _part_metric, records.drawn_candidates(p, "p_partkey", "x", 40))
    return rounded(s.createDataFrame([(mean["size"], mean["brand"], value)], "size int, brand string, variance double"))


add(
    "frechet_mean_records",
    _record_mean,
    f"""WITH c AS (SELECT p_size, p_brand, row_number() OVER (ORDER BY {fits_sql.uniform(1, "p_partkey")}, p_partkey) i FROM part QUALIFY i <= 40),
v AS (SELECT i, any_value(c.p_size) AS size, any_value(c.p_brand) AS brand, avg(pow(abs(part.p_size - c.p_size) / 50.0::DOUBLE + (part.p_brand <> c.p_brand)::INT, 2)) v FROM c, part GROUP BY 1)
SELECT size, brand, round(v, 6) AS variance FROM v ORDER BY v, i LIMIT 1""",
)


def _self_smooth(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d).select("vec_id", *[F.get("x", i).alias(f"x{i}") for i in range(3)])
    return rounded(linear.matrix_frame(s, iforest.self_smoothing_matrix(p, "vec_id", ["x0", "x1", "x2"], 3)), 5)


add("self_smoothing_matrix", _self_smooth)
_TREE = ["l_quantity", "l_discount", "l_tax"]
for _name, _rules, _slack in (("tree_constant", ("constant",), 3.0), ("tree_linear_model", ("constant", "linear", "lines"), 1.5)):

    def _tree(s: SparkSession, d: str, rules: tuple = _rules, slack: float = _slack) -> DataFrame:
        rows = table(s, d, "lineitem")
        t = trees.grow_tree(rows, "l_extendedprice", _TREE, 3, 16, 20, rules, slack)
        return rounded(rows.select("l_orderkey", "l_linenumber", t.predict().alias("prediction")), 2)

    add(_name, _tree)
add("tree_weighted", lambda s, d: rounded(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", trees.grow_tree(table(s, d, "lineitem"), "l_extendedprice", _TREE, 3, 16, weight="l_quantity").predict().alias("prediction")), 2))
_FOREST_SQL = "SELECT l_orderkey * 16 + l_linenumber AS key, {} FROM lineitem"


def _line_forest(name: str, columns: list[str], target: str, kind: str, n: int, depth: int) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        rows = table(s, d, "lineitem").select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("key"), F.array(*columns).alias("x"), target)
        f = forests.grow_forest(rows, "key", "x", [target], n, depth, 5, kind)
        return rounded(forests.forest_predict(rows, "key", "x", f, ["prediction"]), 3)

    source = ", ".join([*(f"{c} AS x{i}" for i, c in enumerate(columns)), f"{target} AS target"])
    add(name, query, forests_sql.forest(_FOREST_SQL.format(source), len(columns), n, depth, 5, kind))


_line_forest("forest_random", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "random", 5, 2)
_line_forest("tree_best_split", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "best", 1, 2)
_line_forest("tree_single_predictor", ["l_quantity"], "l_extendedprice", "random", 1, 2)

for _name, _how, _weight, _boot in (("forest_projection", "precision", None, False), ("forest_projection_determinant", "determinant", None, True), ("forest_projection_weighted", "precision", "case", False)):

    def _forest(s: SparkSession, d: str, how: str = _how, weight: str | None = _weight, boot: bool = _boot) -> DataFrame:
        p = _points(s, d).select("vec_id", F.slice("x", 1, 63).alias("x"), "y", F.get("x", 63).alias("z"), (1 + F.pmod("vec_id", F.lit(3))).alias("case"))
        f = forests.grow_forest(p, "vec_id", "x", ["y", "z"], 10, 6, 5, "projection", weight=weight, bootstrap=boot)
        return rounded(forests.forest_predict(p, "vec_id", "x", f, ["y", "z"], how), 5)

    add(_name, _forest)

for _name, _rules in (("forest_model_constant", ("constant",)), ("forest_model_linear", ("constant", "linear", "lines"))):

    def _model_forest(s: SparkSession, d: str, rules: tuple = _rules) -> DataFrame:
        rows = table(s, d, "lineitem").withColumn("key", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
        f = trees.grow_model_forest(rows, "key", "l_extendedprice", _TREE, 3, depth=2, bins=16, rules=rules)
        return rounded(rows.select("l_orderkey", "l_linenumber", trees.model_forest_predict(f).alias("prediction")), 2)

    add(_name, _model_forest)


def _link_net(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d).select("vec_id", "y", *[F.get("x", i).alias(f"x{i}") for i in range(64)])
    net = networks.fit_link_net(p, "y", [f"x{i}" for i in range(64)])
    return rounded(p.select("vec_id", net.predict().alias("prediction")), 5)


add("link_net", _link_net)
add(
    "hopfield_weights",
    lambda s, d: rounded(networks.hebbian_weights(table(s, d, "part"), "p_size", 8).select(F.col("i").cast("long"), F.col("j").cast("long"), "w")),
    """WITH b AS (SELECT i, j, (2 * ((p_size >> i::INT) & 1) - 1) * (2 * ((p_size >> j::INT) & 1) - 1) s FROM part, range(0, 8) a(i), range(0, 8) b(j) WHERE i <> j)
SELECT i, j, round(avg(s), 6) + 0.0::DOUBLE AS w FROM b GROUP BY 1, 2""",
)


def _recall(s: SparkSession, d: str) -> DataFrame:
    """Patterns from the names of the regions; each is looked for with one bit wrong."""
    patterns = table(s, d, "region").select("r_regionkey", (F.crc32("r_name") % 65536).alias("p"))
    net = networks.train_hopfield(patterns, "p", 16)
    probes = [(r["r_regionkey"], r["p"] ^ 1 << r["r_regionkey"]) for r in patterns.collect()]  # five rows
    return rounded(s.createDataFrame([(k, p, net.recall(p), net.energy(net.recall(p))) for k, p in probes], "r_regionkey long, probe long, found long, energy double"))


add("hopfield_recall", _recall)
add("projection_smoother", lambda s, d: rounded(networks.projection_smoother(table(s, d, "customer").withColumn("c_phase", F.sin("c_custkey") * 1000), "c_custkey", "c_nationkey", ["c_acctbal", "c_phase"], 3, 8), 4))
add("self_projection_smoother", lambda s, d: rounded(networks.self_projection_smoother(table(s, d, "customer").withColumn("n", F.col("c_nationkey").cast("double")), "c_custkey", ["c_acctbal", "n"], 2, 8), 4))

# Samples and resampling.



def _units(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", "c_acctbal", ((F.col("c_acctbal") + 1500) / 40000).alias("pik"))


_UNITS = "WITH u AS (SELECT c_custkey, c_acctbal, (c_acctbal + 1500) / 40000 AS pik FROM customer), "
_u1 = fits_sql.uniform(1, "c_custkey")
add(
    "sample_with_replacement",
    lambda s, d: sampling.simple_with_replacement(_units(s, d), "c_custkey", 100, 1),
    _UNITS
    + f"""n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 t, count(*) OVER () n FROM u), d AS (SELECT floor({fits_sql.uniform(1, 'id')} * (SELECT count(*) FROM u)) t FROM range(0, 100) r(id))
SELECT c_custkey, count(*) AS count FROM n JOIN d USING (t) GROUP BY 1""",
)
add("sample_without_replacement", lambda s, d: sampling.simple_without_replacement(_units(s, d), "c_custkey", 100, 1), _UNITS + f"v AS (SELECT *, {_u1} r FROM u ORDER BY r, c_custkey LIMIT 100) SELECT c_custkey, c_acctbal, pik FROM v")
add("sample_poisson", lambda s, d: sampling.poisson(_units(s, d), "c_custkey", "pik", 1), _UNITS + f"v AS (SELECT * FROM u WHERE {_u1} < pik) SELECT * FROM v")


def _twenty(s: SparkSession, d: str) -> DataFrame:
    """Shares that add up to 20."""
    rows = table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") + 1500).alias("a"))
    return rows.select("c_custkey", (F.col("a") * (20.0 / rows.agg(F.sum("a")).first()[0])).alias("pik"))


add(
    "sample_conditional_poisson",
    lambda s, d: sampling.conditional_poisson(_twenty(s, d), "c_custkey", "pik", 20, 1).select("c_custkey"),
    f"""WITH u AS (SELECT c_custkey, (c_acctbal + 1500) * (20.0::DOUBLE / (SELECT sum(c_acctbal + 1500) FROM customer)) pik FROM customer),
v AS (SELECT t, c_custkey FROM u, range(0, 256) r(t) WHERE {fits_sql.uniform('4099 + t', 'c_custkey')} < pik)
SELECT c_custkey FROM v WHERE t = (SELECT min(t) FROM (SELECT t FROM v GROUP BY t HAVING count(*) = 20))""",
)
add(
    "sample_pareto",
    lambda s, d: sampling.pareto(_units(s, d), "c_custkey", "pik", 100, 1),
    _UNITS + f"v AS (SELECT *, {_u1} r FROM u), w AS (SELECT *, r * (1 - pik) / nullif(pik * (1 - r), 0) q FROM v) SELECT c_custkey, c_acctbal, pik FROM w WHERE q IS NOT NULL ORDER BY q, c_custkey LIMIT 100",
)
add(
    "sample_multinomial",
    lambda s, d: sampling.multinomial(_units(s, d), "c_custkey", "pik", 200, 1),
    _UNITS
    + f"""v AS (SELECT c_custkey, pik, sum(pik) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) hi FROM u WHERE pik > 0), d AS (SELECT {fits_sql.uniform(1, 'id')} * (SELECT sum(pik) FROM v) t FROM range(0, 200) r(id))
SELECT c_custkey, count(*) AS count FROM v JOIN d ON t >= hi - pik AND t < hi GROUP BY 1""",
)
add(
    "sample_systematic",
    lambda s, d: sampling.systematic(_units(s, d), "c_custkey", "pik", start=0.3).select("c_custkey"),
    _UNITS + "v AS (SELECT c_custkey, pik, sum(pik) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) hi FROM u) SELECT c_custkey FROM v WHERE floor(hi - 0.3::DOUBLE) > floor(hi - pik - 0.3::DOUBLE)",
)
_ub = fits_sql.uniform(1, "c_custkey", "b")
add(
    "bootstrap_mean",
    lambda s, d: rounded(sampling.bootstrap(table(s, d, "customer"), "c_custkey", "c_acctbal", 50, F.avg, 1), 4),
    f"WITH v AS (SELECT b, c_acctbal x, {_ub} u FROM customer, range(0, 50) r(b)), n AS (SELECT b, x, {fits_sql.poisson_copies('u')} n FROM v) SELECT b::INT AS b, round(sum(n * x) / sum(n), 4) AS value FROM n GROUP BY b",
)
add(
    "subsample_median",
    lambda s, d: rounded(sampling.subsample(table(s, d, "customer"), "c_custkey", "c_acctbal", 256, 50, F.median, 1), 4),
    f"SELECT b::INT AS b, round(median(c_acctbal), 4) AS value FROM customer, range(0, 50) r(b) WHERE {_ub} < 256 / (SELECT count(*) FROM customer)::DOUBLE GROUP BY b",
)
add(
    "jackknife_mean",
    lambda s, d: rounded(sampling.jackknife_mean(table(s, d, "customer"), "c_acctbal"), 4),
    """WITH k AS (SELECT sum(c_acctbal) s, count(*)::DOUBLE n FROM customer), l AS (SELECT (s - c_acctbal) / (n - 1) t, n FROM customer, k)
SELECT round(avg(t), 4) AS mean, round(var_pop(t) * any_value(n) / (any_value(n) - 1), 4) AS variance FROM l""",
)


def _jackknife(s: SparkSession, d: str) -> DataFrame:
    x = F.col("c_acctbal")
    pv = sampling.pseudo_values(table(s, d, "customer"), "c_custkey", "c_acctbal", lambda t, n: F.get(t, 1) / n - F.pow(F.get(t, 0) / n, F.lit(2.0)), [x, x * x])
    return rounded(sampling.jackknife(pv).select("estimate"), 1)


add("jackknife_variance", _jackknife, "SELECT round(var_samp(c_acctbal), 1) AS estimate FROM customer")
add("shuffle", lambda s, d: sampling.shuffled(table(s, d, "nation").select("n_nationkey"), "n_nationkey", 1), "SELECT n_nationkey FROM nation")
add("sort_reals", lambda s, d: table(s, d, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey"), "SELECT c_custkey, c_acctbal FROM customer")
add(
    "sort_by_reference",
    lambda s, d: table(s, d, "part").select("p_partkey", F.abs(F.col("p_size") - 25).alias("away")).orderBy("away", "p_partkey"),
    "SELECT p_partkey, abs(p_size - 25) AS away FROM part",
)

# Text, qubits, graphs, running means.


def _texts(s: SparkSession, d: str, f) -> DataFrame:
    b = table(s, d, "benchmark")
    other = b.where("item_id % 20 = 0").select(F.col("item_id").alias("query"), F.col("text").alias("other"))
    return rounded(b.crossJoin(F.broadcast(other)).select("item_id", "query", f("text", "other").alias("value")))  # a stated query set


add("ncd_zlib", lambda s, d: _texts(s, d, textdist.ncd_z))
add("ncd_lzma", lambda s, d: _texts(s, d, textdist.ncd_x))
add("lzjd", lambda s, d: _texts(s, d, textdist.lzjd))


def _documents_lzjd(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return textdist.lz_jaccard_to(docs, docs.where("doc_id % 20 = 0"), digits=6)


add("lzjd_documents", _documents_lzjd)


def _qubits(s: SparkSession, d: str) -> DataFrame:
    a = F.col("n_nationkey") / 25
    q = qubit.state(F.cos(a), 0.0, F.sin(a), 0.0)
    gates = {
        "identity": qubit.I2, "x": qubit.X, "y": qubit.Y, "z": qubit.Z, "sqrt_not": qubit.SQRT_NOT, "hadamard": qubit.HADAMARD,
        "rx": qubit.rotation("x", 0.7), "ry": qubit.rotation("y", 0.7), "rz": qubit.rotation("z", 0.7), "phase": qubit.phase_shift(0.4),
    }
    return rounded(table(s, d, "nation").select("n_nationkey", *[qubit.probability_one(qubit.apply(g, q)).alias(n) for n, g in gates.items()]))


add(
    "qubit_gates",
    _qubits,
    """WITH v AS (SELECT n_nationkey, cos(n_nationkey / 25) a, sin(n_nationkey / 25) b FROM nation)
SELECT n_nationkey, round(b * b, 6) AS identity, round(a * a, 6) AS x, round(a * a, 6) AS y, round(b * b, 6) AS z, round(0.5::DOUBLE, 6) AS sqrt_not, round(pow(a - b, 2) / 2, 6) AS hadamard,
round(pow(b * cos(0.35), 2) + pow(a * sin(0.35), 2), 6) AS rx, round(pow(a * sin(0.35) + b * cos(0.35), 2), 6) AS ry, round(b * b, 6) AS rz, round(b * b, 6) AS phase FROM v""",
)
add(
    "qubit_observation",
    lambda s, d: table(s, d, "nation").select("n_nationkey", qubit.observe(qubit.state(0.6, 0.0, 0.8, 0.0), 1, "n_nationkey").alias("seen")),
    f"SELECT n_nationkey, ({fits_sql.uniform(1, 'n_nationkey')} < 0.8::DOUBLE * 0.8::DOUBLE)::INT AS seen FROM nation",
)


def _graph(s: SparkSession, d: str) -> DataFrame:
    nodes = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("attr"))
    edges = table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("src"), F.pmod("c_nationkey", F.lit(5)).alias("dst"), F.col("o_totalprice").alias("attr"))
    return Graph(nodes, edges).degrees()


add(
    "graph_degrees",
    _graph,
    """WITH e AS (SELECT c_nationkey src, c_nationkey % 5 dst FROM customer JOIN orders ON c_custkey = o_custkey)
SELECT n_nationkey AS id, (SELECT count(*) FROM e WHERE src = n_nationkey) AS out_degree, (SELECT count(*) FROM e WHERE dst = n_nationkey) AS in_degree FROM nation""",
)
_RUNNING = {"arithmetic": "sum(value) OVER w", "geometric": "exp(avg(ln(value)) OVER w)", "harmonic": "1 / avg(1 / value) OVER w"}
for _kind, _sql in (("arithmetic", "avg(value)"), ("geometric", "exp(avg(ln(value)))"), ("harmonic", "1 / avg(1 / value)")):
    # logarithms and inverses need numbers above zero
    _where = "true" if _kind == "arithmetic" else "value > 0"
    # values are whole cents, whose means would often lie half-way between two
    # rounded numbers: their sums do not
    _shown = "mean * n" if _kind == "arithmetic" else "mean"
    add(
        f"online_mean_{_kind}",
        lambda s, d, k=_kind, w=_where: rounded(online.online_mean(table(s, d, "events").where(w), "value", ["event_type"], k)),
        f"SELECT event_type, count(*) AS n, round({_sql}, 6) + 0.0::DOUBLE AS mean FROM events WHERE {_where} GROUP BY 1",
    )
    add(
        f"running_mean_{_kind}",
        lambda s, d, k=_kind, w=_where, x=_shown: rounded(online.running_mean(table(s, d, "events").where(w).select("event_id", "event_type", "value"), "value", ["event_id"], ["event_type"], k).select("event_id", "n", F.expr(x).alias("mean")), 5),
        f"SELECT event_id, count(*) OVER w AS n, round({_RUNNING[_kind]}, 5) + 0.0::DOUBLE AS mean FROM events WHERE {_where} WINDOW w AS (PARTITION BY event_type ORDER BY event_id)",
    )
add(
    "online_mean_generalized",
    lambda s, d: rounded(online.online_mean(table(s, d, "events"), "value", ["event_type"], "generalized", lambda v: F.exp(v / 100), lambda m: 100 * F.log(m))),
    "SELECT event_type, count(*) AS n, round(100 * ln(avg(exp(value / 100))), 6) + 0.0::DOUBLE AS mean FROM events GROUP BY 1",
)

# Optimisers on an objective from data, models as tables, the data dictionary.


def _optimisers(s: SparkSession, d: str) -> DataFrame:
    goal = np.array(table(s, d, "lineitem").agg(F.avg("l_discount") * 10, F.avg("l_tax") * 10).first(), float)
    f = lambda v: float(((v - goal) ** 2).sum())
    g = lambda v: 2 * (v - goal)
    h = lambda v: 2 * np.eye(2)
    o, x = optimize, np.zeros(2)
    found = {
        "adadelta": o.adadelta(x, g, 4000), "adagrad": o.adagrad(x, g, 3000, 0.1), "adam": o.adam(x, g, 3000, 0.01), "adamw": o.adamw(x, g, 3000, 0.01, 0.0), "lion": o.lion(x, g, 4000, 0.001, decay=0.0),
        "rmsprop": o.rmsprop(x, g, 3000, 0.01), "yogi": o.yogi(x, g, 4000), "proximal_gradient": o.proximal_gradient(x, g, lambda v: 0.0, 60), "gauss_newton": o.gauss_newton(x, g, h, 2),
        "levenberg": o.levenberg(x, lambda v: v - goal, lambda v: np.eye(2), 30), "marquardt": o.marquardt(x, lambda v: v - goal, lambda v: np.eye(2), 30), "third_order": o.third_order(x, g, h, 2),
        "steepest_coordinate": o.steepest_coordinate(x, f, 2000, 0.05), "adaptive_block_descent": o.adaptive_block_descent(x, f, 200),
    }
    found |= {f"coordinate_descent_{k}": o.coordinate_descent(x, f, 20, k) for k in ("cyclic", "random", "greedy", "sweep")}
    found |= {f"accelerated_coordinate_{k}": o.accelerated_coordinate(x, f, 1500, 0.02, k) for k in ("greedy", "random", "semigreedy")}
    found |= {f"block_descent_{k}": o.block_descent(x, f, 1, 200, k) for k in ("cyclic", "random", "greedy")}
    return s.createDataFrame([(n, bool(np.abs(v - goal).max() < 0.03)) for n, v in found.items()], "optimiser string, reached boolean")


_OPTIMISERS = """adadelta adagrad adam adamw lion rmsprop yogi proximal_gradient gauss_newton levenberg marquardt third_order steepest_coordinate adaptive_block_descent
coordinate_descent_cyclic coordinate_descent_random coordinate_descent_greedy coordinate_descent_sweep accelerated_coordinate_greedy accelerated_coordinate_random accelerated_coordinate_semigreedy
block_descent_cyclic block_descent_random block_descent_greedy""".split()
add("optimisers", _optimisers, " UNION ALL ".join(f"SELECT '{n}' AS optimiser, true AS reached" for n in _OPTIMISERS))


def _constrained(s: SparkSession, d: str) -> DataFrame:
    shares = table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy("o_orderstatus").collect()
    p = np.array([r["n"] for r in shares], float)
    p /= p.sum()
    w = optimize.minimise_on_simplex(len(p), lambda v: 2 * (v - p), 1500)
    bits = optimize.binary_quadratic(len(p), lambda v: 2 * (v - (p > 0.3)))
    c, a, b = -p, np.ones((1, len(p))), np.array([1.0])
    one, two = optimize.binary_linear_penalty(c, a, b), optimize.binary_linear_admm(c, a, b)
    rows = [(r["o_orderstatus"], bool(abs(w[i] - p[i]) < 0.01), int(bits[i]), int(one[i]), int(two[i])) for i, r in enumerate(shares)]
    return s.createDataFrame(rows, "o_orderstatus string, simplex boolean, quadratic int, penalty int, admm int")


add(
    "optimisers_constrained",
    _constrained,
    """WITH p AS (SELECT o_orderstatus, count(*) / (SELECT count(*) FROM orders)::DOUBLE p FROM orders GROUP BY 1)
SELECT o_orderstatus, true AS simplex, (p > 0.3)::INT AS quadratic, (p = (SELECT max(p) FROM p))::INT AS penalty, (p = (SELECT max(p) FROM p))::INT AS admm FROM p""",
)


def _likelihood(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer")
    multiplier, _ = descriptive.empirical_likelihood(rows, "c_acctbal", 4000.0)
    weighed = descriptive.empirical_weights(rows, "c_acctbal", 4000.0, multiplier)
    return rounded(weighed.agg(F.avg("weight").alias("mean_weight"), F.avg(F.col("weight") * F.col("c_acctbal")).alias("mean")), 4)


add("empirical_likelihood", _likelihood, "SELECT 1.0::DOUBLE AS mean_weight, 4000.0::DOUBLE AS mean")


def _model_table(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d).select("vec_id", "y", *[F.get("x", i).alias(f"x{i}") for i in range(64)])
    path = f"{shared_folder(s)}/model-{uuid.uuid4().hex}"
    save_model(s, networks.fit_link_net(p, "y", [f"x{i}" for i in range(64)]), path)
    return rounded(p.select("vec_id", load_model(s, networks.LinkNet, path).predict().alias("prediction")), 5)


add("model_round_trip", _model_table)
add(
    "data_dictionary",
    lambda s, d: dictionary(describe(describe(table(s, d, "region"), "r_regionkey", "integer", "key", 0.0, 4.0), "r_name", "nominal")),
    "SELECT 'r_regionkey' AS name, 'integer' AS scale, 0.0::DOUBLE AS low, 4.0::DOUBLE AS high, 'key' AS text UNION ALL SELECT 'r_name', 'nominal', NULL, NULL, ''",
)
