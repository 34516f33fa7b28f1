"""The library from SQL: functions and table functions of a session.

Scalar functions are SQL bodies, which Catalyst puts in place of the call, so nothing
leaves the JVM.  Table functions are fed by partitions (``TABLE(t) PARTITION BY ... ORDER BY
...``) and hold no more than a count or the last few values of one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

_PAIR = "x ARRAY<DOUBLE>, y ARRAY<DOUBLE>"


def _sum(f: str) -> str:
    return f"aggregate(zip_with(x, y, (a, b) -> {f}), 0D, (s, v) -> s + v)"


def _kernel(value: str) -> str:
    return f"CASE WHEN abs(x) <= 1 THEN {value} ELSE 0D END"


#: Name, parameters and body of each scalar function; all give doubles.
SCALARS = [
    ("euclidean_distance", _PAIR, f"sqrt({_sum('(a - b) * (a - b)')})"),
    ("manhattan_distance", _PAIR, _sum("abs(a - b)")),
    ("chebyshev_distance", _PAIR, "aggregate(zip_with(x, y, (a, b) -> abs(a - b)), 0D, (s, v) -> greatest(s, v))"),
    ("minkowski_distance", f"{_PAIR}, p DOUBLE", f"pow({_sum('pow(abs(a - b), p)')}, 1 / p)"),
    ("uniform_kernel", "x DOUBLE", _kernel("0.5D")),
    ("triangular_kernel", "x DOUBLE", _kernel("1 - abs(x)")),
    ("epanechnikov_kernel", "x DOUBLE", _kernel("0.75D * (1 - x * x)")),
    ("gaussian_kernel", "x DOUBLE", "exp(-0.5D * x * x) / sqrt(2 * pi())"),
    ("dnorm", "x DOUBLE, m DOUBLE, s DOUBLE", "CASE WHEN s > 0 THEN exp(-0.5D * pow((x - m) / s, 2)) / (s * sqrt(2 * pi())) END"),
    ("dexp", "x DOUBLE, rate DOUBLE", "CASE WHEN rate > 0 THEN CASE WHEN x < 0 THEN 0D ELSE rate * exp(-rate * x) END END"),
    ("clamp", "x DOUBLE, low DOUBLE, high DOUBLE", "CASE WHEN x IS NOT NULL THEN least(high, greatest(low, x)) END"),
]


@udtf(returnType="value string, count bigint")
class FrequencyTable:
    """``frequency_table(TABLE(SELECT v FROM t) PARTITION BY v)``: each value, as text,
    with its number of rows; null is a value."""

    def __init__(self) -> None:
        self.value: str | None = None
        self.n = 0

    def eval(self, row: Row) -> None:
        self.value = None if row[0] is None else str(row[0])
        self.n += 1

    def terminate(self) -> Iterator[tuple[str | None, int]]:
        if self.n:
            yield self.value, self.n


@udtf(returnType="key string, position bigint, target double, lags array<double>")
class LagMatrix:
    """``lag_matrix(p, TABLE(SELECT key, x, time FROM t) PARTITION BY key ORDER BY time)``:
    each value with the ``p`` before it, the nearest first, and its place in the key's order
    from 1; rows without all lags, or with a null or NaN among them, are left out."""

    def __init__(self) -> None:
        self.last: deque[float | None] = deque()
        self.n = 0

    def eval(self, p: int, row: Row) -> Iterator[tuple[str | None, int, float, list[float]]]:
        x = row[1]
        x = None if x is None or x != x else float(x)
        self.n += 1
        if x is not None and len(self.last) == p and None not in self.last:
            yield None if row[0] is None else str(row[0]), self.n, x, list(self.last)
        self.last.appendleft(x)
        while len(self.last) > p:
            self.last.pop()


TABLES = {"frequency_table": FrequencyTable, "lag_matrix": LagMatrix}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session, by the names that are returned;
    functions of its own with these names are replaced."""
    for name, takes, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS DOUBLE RETURN {body}")
    for name, f in TABLES.items():
        spark.udtf.register(name, f)
    return [*(s[0] for s in SCALARS), *TABLES]
