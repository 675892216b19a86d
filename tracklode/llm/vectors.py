"""Shared parts of the vector operators: usable vectors, groups of equal vectors, learned rotation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklode.functions.groups import group_bounds, whole_groups  # noqa: F401
from tracklode.runtime import is_finite

#: Rows the rotation is fitted on at most.
FIT_ROWS = 20_000


def usable(df: DataFrame, dim: int, id_col: str = "rid", vec_col: str = "features") -> DataFrame:
    """(rid, v): vectors of exactly `dim` finite elements. Null rids, null or short or long arrays and
    arrays with a null, NaN or infinity are left out; a rid that comes with several vectors keeps
    the least one. Other columns are ignored."""
    v = F.col(vec_col).cast("array<double>")
    t = df.select(F.col(id_col).cast("string").alias("rid"), v.alias("v")).where(F.col("rid").isNotNull() & (F.size("v") == dim))
    return t.where(F.forall("v", is_finite)).groupBy("rid").agg(F.min("v").alias("v"))


def classes(points: DataFrame) -> DataFrame:
    """(rep, v, n): equal vectors once, under the smallest rid, with the number of rids."""
    return points.groupBy("v").agg(F.min("rid").alias("rep"), F.count("*").alias("n")).select("rep", "v", "n")


def fit_rotation(reps: DataFrame, n: int, dim: int, seed: int, rows: int = FIT_ROWS, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation learned on a bounded sample by hash: principal axes, then the iterative
    quantisation that turns them so that sign codes lose least."""
    # signs and the order of the sample are fixed, so every machine learns the same rotation
    part = reps if n <= rows else reps.where(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1_000_003)) < F.lit(int(1_000_003 * rows / n)))
    x = np.array([r[0] for r in part.select("v", "rep").limit(2 * rows).orderBy("rep").collect()], float).reshape(-1, dim)
    if not len(x):
        return np.zeros(dim), np.eye(dim)
    mean = x.mean(0)
    x = x - mean
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None], 0) < 0, -1.0, 1.0)
    y = x @ axes
    turn, up = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    turn = turn * np.where(np.diag(up) < 0, -1.0, 1.0)
    for _ in range(steps):
        a, _, b = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
        turn = (a @ b).T
    return mean, axes @ turn


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


def exact_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(-1))


def near_pairs(x: np.ndarray, y: np.ndarray, limit: float, most: int | None = None, same: bool = False):
    """Row numbers (i, j) and distances of pairs within `limit`; with `most`, of each row of x only
    the nearest `most`, equal distances by the smaller j. same: x is y, and i = j is left out.
    Works in blocks, so memory stays bounded."""
    mid = x.mean(0)
    a, b = x - mid, y - mid
    b2 = (b * b).sum(1)
    scale = 1e-9 * (1 + float((a * a).sum(1).max(initial=0)) + float(b2.max(initial=0)))
    block = max(1, min(len(a), 8_000_000 // max(1, len(b))))
    out = []
    for s in range(0, len(a), block):
        d2 = (a[s : s + block] ** 2).sum(1)[:, None] + b2 - 2 * (a[s : s + block] @ b.T)
        if same:
            r = np.arange(d2.shape[0])
            d2[r, r + s] = np.inf
        cut = np.full(d2.shape[0], limit * limit)
        if most is not None and d2.shape[1] > most:
            cut = np.minimum(cut, np.partition(d2, most - 1, axis=1)[:, most - 1])
        i, j = np.nonzero(d2 <= (cut + scale)[:, None])
        d = exact_distance(x[i + s], y[j])
        ok = d <= limit
        i, j, d = i[ok], j[ok], d[ok]
        if most is not None and len(i):
            o = np.lexsort((j, d, i))
            i, j, d = i[o], j[o], d[o]
            first = np.searchsorted(i, i)
            ok = np.arange(len(i)) - first < most
            i, j, d = i[ok], j[ok], d[ok]
        out.append((i + s, j, d))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
