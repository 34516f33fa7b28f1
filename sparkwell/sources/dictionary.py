"""A data dictionary in column metadata: name, measurement scale, range, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALES = ("nominal", "ordinal", "integer", "real", "complex", "other")


def describe(df: DataFrame, column: str, scale: str, text: str = "", low: float | None = None, high: float | None = None) -> DataFrame:
    """``df`` with the dictionary entry of a column; the data stay as they are."""
    if scale not in SCALES:
        raise ValueError(f"scale must be one of {', '.join(SCALES)}")
    entry = {"scale": scale, "text": text, "low": low, "high": high}
    return df.withColumn(column, F.col(column).alias(column, metadata=entry))


def dictionary(df: DataFrame) -> DataFrame:
    """``name``, ``scale``, ``low``, ``high``, ``text`` of the columns; ``other``
    where nothing was said."""
    rows = [
        (f.name, m.get("scale", "other"), m.get("low"), m.get("high"), m.get("text", ""))
        for f in df.schema
        for m in [f.metadata or {}]
    ]
    return df.sparkSession.createDataFrame(rows, "name string, scale string, low double, high double, text string")
