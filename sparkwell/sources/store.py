"""Tables of the driver's folder, and models kept as tables."""

from __future__ import annotations

import dataclasses
import json
import tempfile
import uuid
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode without it a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/sparkwell-shared"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _plain(v: Any) -> Any:
    if isinstance(v, np.ndarray):
        return {"array": v.tolist()}
    if dataclasses.is_dataclass(v):
        return {f.name: _plain(getattr(v, f.name)) for f in dataclasses.fields(v)}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def _back(v: Any) -> Any:
    if isinstance(v, dict) and v.keys() == {"array"}:
        return np.array(v["array"])
    if isinstance(v, dict):
        return {k: _back(x) for k, x in v.items()}
    return [_back(x) for x in v] if isinstance(v, list) else v


def save_model(spark: SparkSession, model: Any, path: str) -> None:
    """A model dataclass as a Parquet table of one row."""
    rows = [(type(model).__name__, json.dumps(_plain(model)))]
    spark.createDataFrame(rows, "kind string, fields string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, kind: type, path: str) -> Any:
    row = spark.read.parquet(path).first()
    if row is None or row["kind"] != kind.__name__:
        raise ValueError(f"{path} holds no {kind.__name__}")
    return kind(**_back(json.loads(row["fields"])))


@dataclasses.dataclass(frozen=True)
class Graph:
    """A property graph: ``vertices`` (id, attr) and directed ``edges`` (src, dst, attr)."""

    vertices: DataFrame
    edges: DataFrame

    def degrees(self) -> DataFrame:
        from pyspark.sql import functions as F

        ends = self.edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
        both = ends.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
            ends.select("dst", F.lit(0), F.lit(1))
        )
        sums = both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
        return self.vertices.select("id").join(sums, "id", "left").fillna(0)
