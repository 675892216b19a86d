"""Session defaults, shared-folder tables and other things every operator needs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tracklode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword names use __ for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; only where
    that is unset (tests, local mode) a folder of our own is made and recorded there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tracklode-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables in the shared folder that cut lineage and survive the loss of executors.

    `table` writes a DataFrame once and reads it back; `drop` removes a table that is no longer
    needed. What is left (the last tables still feed the returned DataFrame) goes at exit.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        ready_workers(spark)
        atexit.register(self.close)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                _delete(self.spark, path)

    def close(self) -> None:
        try:
            _delete(self.spark, self.base)
        except Exception:  # the session may be gone already
            pass


def ready_workers(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, installed or not."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least_rows: int = 2_000) -> DataFrame:
    """Rows over all cores ahead of CPU-bound work per row; keeps well-split inputs as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def is_finite(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
