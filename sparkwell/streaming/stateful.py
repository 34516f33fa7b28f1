"""Running means of a stream, event by event.

Each key's number and sum are values in Spark's state store; every event comes out with
the mean of its key so far.  State that no event has touched for a time can be let go.
The store must be RocksDB's (``use_rocksdb``), as Spark asks for user state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.expr import Unary, clean
from .online import _mapped

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep user state in RocksDB, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Running(StatefulProcessor):
    """Adds each event's ``z`` to its key's sum, in the order of ``t`` and ``id``.
    Within a batch sums are compensated (Neumaier), and the state keeps both parts."""

    def __init__(self, expire_ms: int | None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sum", "n bigint, high double, low double", self.expire_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batches = [p for p in rows if len(p)]
        if not batches:
            return
        n, high, low = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
        events = pd.concat(batches, ignore_index=True).sort_values(["t", "id"], kind="stable", na_position="first")
        counts, means = [], []
        for z in events["z"].to_numpy(float):
            if not np.isnan(z):
                n += 1
                total = high + z
                low += (high - total) + z if abs(high) >= abs(z) else (z - total) + high
                high = total
            counts.append(n)
            means.append((high + low) / n if n else None)
        self.state.update((n, high, low))
        out = events.drop(columns="z").assign(n=counts, m=pd.Series(means, index=events.index, dtype=float))
        yield out

    def close(self) -> None:
        pass


def running_means(stream: DataFrame, x: str, key: str, time: str, event: str, kind: str = "arithmetic", f: Unary | None = None, inverse: Unary | None = None, expire_ms: int | None = None) -> DataFrame:
    """``key``, ``event`` (its id), ``time``, ``n`` and ``mean`` for each event of a stream (append
    output): the mean of the key's values up to and with it.

    Events of one micro-batch are taken in order of ``time`` and ``event``, batches as they
    come.  A null or NaN value comes out with the mean before it, null if there is none.
    ``kind`` as for ``online_mean``.  ``expire_ms``: the state of a key that no batch has
    touched for so long (by the clock) is dropped, and its next event starts anew.  A query
    that starts again from its checkpoint goes on where it was.  A key's events of a
    batch are handled by one task.
    """
    there, back = _mapped(kind, f, inverse)
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, event, time)}
    rows = stream.select(F.col(key).alias("k"), F.col(event).alias("id"), F.col(time).alias("t"), there(clean(x)).alias("z"))
    shape = f"k {kinds[key]}, id {kinds[event]}, t {kinds[time]}, n bigint, m double"
    out = rows.groupBy("k").transformWithStateInPandas(statefulProcessor=_Running(expire_ms), outputStructType=shape, outputMode="Append", timeMode="ProcessingTime" if expire_ms else "None")
    return out.select(F.col("k").alias(key), F.col("id").alias(event), F.col("t").alias(time), "n", back(F.col("m")).alias("mean"))
