"""Dense ids in an order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklode.functions.groups import partitions
from tracklode.runtime import Scratch


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Adds `name`: start, start + 1, … in the order given. Rows are range-partitioned and sorted;
    each partition's first id is the number of rows before it. `order` must not tie."""
    scratch = Scratch(df.sparkSession, "ids")
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    t = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    t = scratch.table(t.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    counts = t.groupBy("_p").count()  # one row per partition
    before = counts.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))
    return t.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + local + start).drop("_p", "_m", "_before")
