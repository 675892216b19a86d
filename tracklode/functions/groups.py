"""Work on complete groups inside partitions that are sorted by a key, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def whole_groups(batches, key: str):
    """Arrow tables of complete groups from batches sorted by `key`; a group is never cut."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        at = b.schema.get_field_index(key)
        k = b.column(at).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1]))  # start of the last group in this batch
        if kept and last == 0 and kept[-1].column(at)[0].as_py() == k[0]:
            kept.append(b)
            continue
        if last > 0:
            yield pa.Table.from_batches([*kept, b.slice(0, last)]).combine_chunks()
        elif kept:
            yield pa.Table.from_batches(kept).combine_chunks()
        kept = [b.slice(last)]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def group_bounds(k: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]]) if len(k) else np.array([0])


def partitions(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of equal keys next to each other, ready for whole_groups."""
    return df.repartition(partitions(df.sparkSession), key).sortWithinPartitions(key, *order)


def leaves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in parts of at most `most`, halved along the widest dimension."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        axis = int(np.argmax(np.ptp(x[at], axis=0)))
        at = at[np.argsort(x[at, axis], kind="stable")]
        todo += [at[len(at) // 2 :], at[: len(at) // 2]]
    return out
