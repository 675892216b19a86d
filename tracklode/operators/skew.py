"""Per-key results when a few keys hold most rows (problem 5).

Rows are range-partitioned on the composite key plus a secondary order (rid, then a row number
that splits even exact repeats), with Spark's sampled quantiles as bounds, so a heavy key is cut
into as many partitions as its share calls for. Each partition folds its sorted rows into one
partial state per key; the few states of a key that straddle partition bounds are then stitched:
a rid that ends one partition and starts the next is counted once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklode.runtime import Scratch

STATE = "part int, entry int, hashValue bigint, n_rows bigint, n_rids bigint, first_rid string, last_rid string"


def _fold(batches):
    """Sorted Arrow batches of one partition -> one partial state per key; the last key of a batch is
    held back until the next one shows whether it goes on."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["part", "entry", "hashValue", "n_rows", "n_rids", "first_rid", "last_rid"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    held = None  # [part, entry, hash, rows, rids, first, last]
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        e, h, rid = (b.column(i) for i in range(3))
        en, hn = e.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)
        new_key = np.concatenate([[True], (en[1:] != en[:-1]) | (hn[1:] != hn[:-1])])
        new_rid = new_key.copy()
        if n > 1:
            new_rid[1:] |= pc.not_equal(rid[1:], rid[:-1]).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new_key)
        rows = np.diff(np.append(start, n))
        rids = np.add.reduceat(new_rid.astype(np.int64), start)
        if held and held[1] == en[0] and held[2] == hn[0]:
            first = rid[0].as_py()
            rows[0] += held[3]
            rids[0] += held[4] - (held[6] == first)
            begin = held[5]
        else:
            begin = rid[0].as_py()
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, kinds)], names=names)
        last = int(start[-1])
        held = [part, int(en[last]), int(hn[last]), int(rows[-1]), int(rids[-1]), begin if len(start) == 1 else rid[last].as_py(), rid[n - 1].as_py()]
        if len(start) > 1:
            at, end = pa.array(start[:-1]), pa.array(start[1:] - 1)
            firsts = pa.concat_arrays([pa.array([begin], pa.string()), rid.take(at[1:]).cast(pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), e.take(at), h.take(at), pa.array(rows[:-1]), pa.array(rids[:-1]), firsts, rid.take(end).cast(pa.string())], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, kinds)], names=names)


def bucket_counts(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """(entry, hashValue, n_rows, n_rids) of each key: rows and distinct rids.

    Rows with a null in rid, entry or hashValue are left out; repeated rows count in n_rows, once
    in n_rids. An empty table gives no rows; other columns of the input are ignored.
    """
    spark = rows.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = (
        rows.select(F.col("entry").cast("int").alias("entry"), F.col("hashValue").cast("bigint").alias("hashValue"), F.col("rid").cast("string").alias("rid"))
        .dropna()
        .withColumn("_n", F.monotonically_increasing_id())
        .repartitionByRange(n, "entry", "hashValue", "rid", "_n")
        .sortWithinPartitions("entry", "hashValue", "rid")
        .select("entry", "hashValue", "rid")
    )
    states = ordered.mapInArrow(_fold, STATE)
    # one state per key and partition: at most `n` rows for any key
    before = F.lag("last_rid").over(Window.partitionBy("entry", "hashValue").orderBy("part"))
    return (
        states.withColumn("_seam", F.when(before == F.col("first_rid"), 1).otherwise(0))
        .groupBy("entry", "hashValue")
        .agg(F.sum("n_rows").alias("n_rows"), (F.sum("n_rids") - F.sum("_seam")).alias("n_rids"))
    )


def heavy_keys(rows: DataFrame, share: float = 0.01, partitions: int | None = None) -> DataFrame:
    """(entry, hashValue) that hold at least `share` of the distinct (rid, entry, hashValue) rows.

    Nulls, repeats and empty tables as in bucket_counts. The total is one row, so it is broadcast.
    """
    per = Scratch(rows.sparkSession, "heavy").table(bucket_counts(rows, partitions))  # one row a key
    total = per.agg(F.sum("n_rids").alias("_total"))
    return per.crossJoin(F.broadcast(total)).where(F.col("n_rids") >= F.lit(share) * F.col("_total")).select("entry", "hashValue")
