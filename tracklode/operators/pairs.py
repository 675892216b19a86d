"""Distances of a stated set of queries to all rows, a block of queries at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklode.functions.arrays import distance

#: Queries a row meets together; the number of blocks, one row each, is what is broadcast.
BLOCK = 1_000


def block_distances(queries: DataFrame, rows: DataFrame, name: str = "RV", block: int = BLOCK, once: bool = False) -> DataFrame:
    """(id1, id2, dist) of every query id1 and row id2, both with id and v array<double>; with `once` only
    pairs with id1 <= id2, as for a set against itself.

    Its size is queries times rows, so the queries should be a stated part. Null ids or vectors are
    left out. A row is sent once per block of queries and meets the block through an equi-join.
    """
    q = queries.where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").alias("id1"), F.col("v").alias("a"))
    n = max(1, -(-q.count() // block))
    ask = q.withColumn("block", F.pmod(F.xxhash64("id1"), F.lit(n)))
    met = rows.where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").alias("id2"), F.col("v").alias("b")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    out = met.join(ask, "block")
    return (out.where("id1 <= id2") if once else out).select("id1", "id2", distance(name)("a", "b").alias("dist"))
