"""k-means: each pass is one aggregation; only the centres reach the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import uniform


@dataclass(frozen=True)
class Centres:
    points: list[list[float]]

    def nearest(self, x: Column) -> Column:
        """Number of the nearest centre, the lowest of equals."""
        d = [
            F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in p]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
            for p in self.points
        ]
        return F.array_position(F.array(*d), F.least(*d) if len(d) > 1 else d[0]) - 1


def k_means(df: DataFrame, x: str, k: int, passes: int = 10, start: list[list[float]] | None = None, key: str | None = None, seed: int = 1) -> Centres:
    """Lloyd's passes on an array column.  Without ``start``, the ``k`` rows whose
    hashed ``key`` is smallest.  An empty cell keeps its centre."""
    if start is None:
        first = df.select(x, uniform(seed, key or x).alias("u")).orderBy("u").limit(k).collect()
        start = [list(map(float, r[0])) for r in first]
    centres = Centres([list(map(float, p)) for p in start])
    dim = len(centres.points[0])
    for _ in range(passes):
        cell = df.select(F.col(x).alias("x"), centres.nearest(F.col(x)).alias("c"))
        rows = cell.groupBy("c").agg(*[F.avg(F.get("x", i)).alias(f"m{i}") for i in range(dim)]).collect()
        points = list(centres.points)
        for r in rows:
            if r["c"] is not None:
                points[r["c"]] = [r[f"m{i}"] for i in range(dim)]
        done = points == centres.points
        centres = Centres(points)
        if done:
            break
    return centres


def assign(df: DataFrame, x: str, centres: Centres, name: str = "cluster") -> DataFrame:
    return df.withColumn(name, centres.nearest(F.col(x)))
