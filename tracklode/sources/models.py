"""Models as folders: metadata as one JSON line, tables as parquet. Loading checks class and columns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: Columns each kind of model must have.
COLUMNS = {
    "patterns": {"pattern", "support"},
    "kmeans": {"cluster", "center"},
    "bisecting": {"node", "size", "center", "norm", "cost", "height", "parent", "leaf"},
    "minhash": {"table", "a", "b"},
    "meanshift": {"cluster", "center", "size"},
    "density": {"cluster", "cell"},
}


def save(spark: SparkSession, path: str, kind: str, data: DataFrame, **metadata) -> None:
    missing = COLUMNS[kind] - set(data.columns)
    if missing:
        raise ValueError(f"a {kind} model needs the columns {sorted(missing)}")
    line = json.dumps({"class": kind, "version": "1.0", **metadata}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    data.write.mode("overwrite").parquet(f"{path}/data")


def load(spark: SparkSession, path: str, kind: str) -> tuple[dict, DataFrame]:
    """(metadata, data); a model of another kind or without its columns is a ValueError."""
    meta = json.loads(spark.read.text(f"{path}/metadata").head()[0])
    if meta.get("class") != kind:
        raise ValueError(f"{path} holds a {meta.get('class')} model, not {kind}")
    data = spark.read.parquet(f"{path}/data")
    missing = COLUMNS[kind] - set(data.columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    return meta, data
