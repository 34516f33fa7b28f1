from __future__ import annotations

import math
import time

import numpy as np
import pytest

from sparkwell.streaming import online, stateful

SCHEMA = "id long, g string, t timestamp, x double"


def events(n=90):
    rng = np.random.default_rng(1)
    x = [None if i % 13 == 5 else float("nan") if i % 17 == 3 else float(v) for i, v in enumerate(rng.uniform(1, 9, n))]
    return [(i, "pqr"[int(rng.integers(3))], i, v) for i, v in enumerate(x)]


def written(spark, rows, folder, at):
    frame = spark.createDataFrame(rows, "id long, g string, s long, x double").selectExpr("id", "g", "timestamp_seconds(s) t", "x")
    frame.coalesce(1).write.parquet(f"{folder}/in/part={at}")


def run(spark, folder, **kw):
    stream = online.file_stream(spark, f"{folder}/in/*", SCHEMA, 1)
    out = stateful.running_means(stream, "x", "g", "t", "id", **kw)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return {r["id"]: (r["g"], r["n"], r["mean"]) for r in spark.read.parquet(f"{folder}/out").collect()}


def want(rows, there=lambda v: v, back=lambda m: m):
    out, seen = {}, {}
    for i, g, _, x in rows:
        held = seen.setdefault(g, [])
        if x is not None and not math.isnan(x):
            held.append(there(x))
        out[i] = (g, len(held), back(math.fsum(held) / len(held)) if held else None)
    return out


def close(got, expected):
    assert got.keys() == expected.keys()
    for i, (g, n, m) in expected.items():
        assert got[i][:2] == (g, n)
        assert got[i][2] == (None if m is None else pytest.approx(m, rel=1e-12)), i


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def test_each_event_has_its_mean_so_far_and_a_restart_goes_on(spark, tmp_path, rocksdb):
    rows = events()
    for k in range(2):
        written(spark, rows[k * 30 : k * 30 + 30], tmp_path, k)
    close(run(spark, tmp_path), want(rows[:60]))
    written(spark, rows[60:], tmp_path, 2)  # the query starts again from its checkpoint
    close(run(spark, tmp_path), want(rows))


def test_geometric_means(spark, tmp_path, rocksdb):
    rows = events(30)
    written(spark, rows, tmp_path, 0)
    close(run(spark, tmp_path, kind="geometric"), want(rows, math.log, math.exp))


def test_state_that_was_not_touched_expires(spark, tmp_path, rocksdb):
    # a stream with processing time has no last batch of its own: it runs until stopped
    (tmp_path / "in").mkdir()
    stream = online.file_stream(spark, f"{tmp_path}/in", SCHEMA, 1)
    seen = {}

    def keep(batch, _):
        seen.update({r["id"]: (r["g"], r["n"], r["mean"]) for r in batch.collect()})

    out = stateful.running_means(stream, "x", "g", "t", "id", expire_ms=2000)
    query = out.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="200 milliseconds").start()

    def until(key):
        for _ in range(100):
            if key in seen:
                return seen[key]
            time.sleep(0.3)
        return None

    def put(row):
        frame = spark.createDataFrame([row], "id long, g string, s long, x double").selectExpr("id", "g", "timestamp_seconds(s) t", "x")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    try:
        put((0, "p", 0, 2.0))
        assert until(0) == ("p", 1, 2.0)
        time.sleep(5)
        put((1, "p", 1, 8.0))
        assert until(1) == ("p", 1, 8.0)
    finally:
        query.stop()
