"""Running means of a stream, and of a table in order.

Streams keep a sum and a count for each key in Spark's state store; a watermark
bounds what is kept of event-time windows.  The generalised mean of any function
that has an inverse needs no custom state: its sum is that of the mapped values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import Unary, clean
from ..plans.ranks import running_sum


def _mapped(kind: str, f: Unary | None, inverse: Unary | None) -> tuple[Unary, Unary]:
    if kind == "arithmetic":
        return (lambda v: v), (lambda m: m)
    if kind == "geometric":
        return F.log, F.exp
    if kind == "harmonic":
        return (lambda v: 1 / F.nullif(v, F.lit(0.0))), (lambda m: 1 / F.nullif(m, F.lit(0.0)))
    if f is None or inverse is None:
        raise ValueError("a generalised mean needs a function and its inverse")
    return f, inverse


def online_mean(stream: DataFrame, x: str, by: list[str], kind: str = "arithmetic", f: Unary | None = None, inverse: Unary | None = None) -> DataFrame:
    """``by``, ``n``, ``mean`` of a stream (update or complete output) or a table;
    NaN and null are passed over."""
    there, back = _mapped(kind, f, inverse)
    z = there(clean(x))
    return stream.groupBy(*by).agg(F.count(z).alias("n"), back(F.avg(z)).alias("mean"))


def windowed_mean(stream: DataFrame, x: str, time: str, width: str, late: str, by: list[str], kind: str = "arithmetic") -> DataFrame:
    """The same in tumbling windows of event time; rows later than ``late`` behind
    the newest are dropped with their state."""
    there, back = _mapped(kind, None, None)
    z = there(clean(x))
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, width), *by).agg(F.count(z).alias("n"), back(F.avg(z)).alias("mean"))


def running_mean(df: DataFrame, x: str, order: list[str], by: list[str], kind: str = "arithmetic", f: Unary | None = None, inverse: Unary | None = None) -> DataFrame:
    """``df`` with ``n`` and ``mean`` of the values up to each row in ``order``."""
    there, back = _mapped(kind, f, inverse)
    z = there(clean(x))
    rows = df.withColumn("_z", F.coalesce(z, F.lit(0.0))).withColumn("_c", z.isNotNull().cast("long"))
    rows = running_sum(rows, by, order, "_z", "_sum", "_t1")
    rows = running_sum(rows, by, order, "_c", "n", "_t2")
    return rows.withColumn("mean", back(F.col("_sum") / F.nullif(F.col("n"), F.lit(0)))).drop("_z", "_c", "_sum", "_t1", "_t2")


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


