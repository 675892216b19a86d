"""Density clustering of points within a radius, and the exploratory counts that go with it.

Equal points are one vertex with a weight. A vertex goes to its own grid cell (SIDE times eps wide)
and, as a border copy, to the neighbouring cells its radius reaches, so every pair within eps meets
in a cell.
Cells are worked through as sorted groups: neither pairs nor cells are ever gathered. In a cell points
lie in leaves; leaves wholly inside or outside a radius count by their sums, only the others are
compared, so a dense cell takes far less than the square of its points.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklode.functions.groups import by_key, group_bounds, leaves, whole_groups
from tracklode.functions.ids import number_rows
from tracklode.operators.graph import connected_components
from tracklode.operators.profile import histogram
from tracklode.runtime import Scratch, is_finite

BLOCK = 4_000_000
#: Width of a cell in radii: wider cells need fewer border copies and more comparisons.
SIDE = 4
#: Points of a leaf.
LEAF = 64
#: Points far from all others that are compared with every point.
FEW = 1_000


def vertices(df: DataFrame, cols: list[str]) -> DataFrame:
    """(v array<double>, w): distinct finite points and their number of rows."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & is_finite(F.col(c).cast("double"))
    return df.where(ok).groupBy(F.array(*(F.col(c).cast("double") for c in cols)).alias("v")).agg(F.count("*").alias("w"))


def _copies(df: DataFrame, dims: int, eps: float) -> DataFrame:
    """Adds cell and home, one row per cell the point belongs to; cells span the first two dimensions."""
    axes = min(dims, 2)
    side, reach = SIDE * eps, eps * (1 + 1e-9)
    base = [F.floor(F.col("v")[i] / side) for i in range(axes)]
    off = [F.col("v")[i] - base[i] * side for i in range(axes)]
    steps = []
    for step in itertools.product((0, -1, 1), repeat=axes):
        ok = F.lit(True)
        for i, s in enumerate(step):
            if s == -1:
                ok = ok & (off[i] <= reach)
            elif s == 1:
                ok = ok & (off[i] >= side - reach)
        steps.append(F.when(ok, F.struct(F.xxhash64(*(base[i] + s for i, s in enumerate(step))).alias("cell"), F.lit(not any(step)).alias("home"))))
    return df.withColumn("_c", F.explode(F.filter(F.array(*steps), lambda x: x.isNotNull()))).select("*", "_c.cell", "_c.home").drop("_c")


#: How the difference of a coordinate enters a distance, how entries combine, and the root taken in the
#: end. No distance is below the difference of any coordinate, so cells of any of them hold all pairs.
MEASURES = {"euclidean": (np.square, np.add, np.sqrt), "manhattan": (np.abs, np.add, np.asarray), "chebyshev": (np.abs, np.maximum, np.asarray)}


def _measure(name: str):
    if name not in MEASURES:
        raise ValueError(f"cells need one of the distances {', '.join(MEASURES)}, not {name!r}")
    return MEASURES[name]


def _blocks(x: np.ndarray, rows: np.ndarray, eps: float, measure: str = "euclidean"):
    """(rows, distances before the root, who is within eps) a block of rows at a time."""
    each, combine, _ = _measure(measure)
    step = max(1, BLOCK // max(1, len(x)))
    for s in range(0, len(rows), step):
        r = rows[s : s + step]
        d = np.zeros((len(r), len(x)))
        for a in range(x.shape[1]):
            combine(d, each(x[r, a][:, None] - x[None, :, a]), out=d)
        yield r, d, d <= each(np.float64(eps))


class _Leaves:
    """The points of a cell in leaves with their boxes."""

    def __init__(self, x: np.ndarray, eps: float, measure: str):
        self.x, self.eps, self.measure = x, eps, measure
        self.rows = leaves(x, LEAF)
        self.low, self.high = (np.array([f(x[r], axis=0) for r in self.rows]) for f in (np.min, np.max))

    def near(self, a: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Leaves from `first` on that lie wholly within eps of every point of leaf a, and those that may
        lie within eps of some."""
        each, combine, _ = _measure(self.measure)
        low, high = self.low[first:], self.high[first:]
        gap = np.maximum(np.maximum(self.low[a] - high, low - self.high[a]), 0.0)
        far = np.maximum(self.high[a] - low, high - self.low[a])
        reach = each(np.float64(self.eps))
        least, most = (combine.reduce(each(d), axis=1) for d in (gap, far))
        inside = most <= reach * (1 - 1e-9)
        return np.flatnonzero(inside) + first, np.flatnonzero(~inside & (least <= reach * (1 + 1e-9))) + first

    def pairs(self, a: int, others: np.ndarray):
        """(rows of leaf a, rows of the others, who is within eps)."""
        at = np.concatenate([self.rows[b] for b in others])
        both = np.concatenate([self.x[self.rows[a]], self.x[at]])
        n = len(self.rows[a])
        each, combine, _ = _measure(self.measure)
        d = np.zeros((n, len(at)))
        for axis in range(both.shape[1]):
            combine(d, each(both[:n, axis][:, None] - both[None, n:, axis]), out=d)
        return self.rows[a], at, d <= each(np.float64(self.eps))


def _weights_near(x: np.ndarray, w: np.ndarray, home: np.ndarray, eps: float, measure: str) -> np.ndarray:
    """Of each row at home the weight within eps of it."""
    out, g = np.zeros(len(x), np.int64), _Leaves(x, eps, measure)
    sums = np.array([w[r].sum() for r in g.rows])
    for a, r in enumerate(g.rows):
        if home[r].any():
            inside, some = g.near(a)
            out[r] = sums[inside].sum()
            if len(some):
                rows, at, close = g.pairs(a, some)
                out[rows] += close @ w[at]
    return out


def _linked(x: np.ndarray, eps: float, measure: str) -> np.ndarray:
    """Component label (a row number) of each row under links within eps."""
    lab, g = np.arange(len(x)), _Leaves(x, eps, measure)

    def join(i, j):
        while True:  # hook the larger root to the smaller one until both ends agree
            while (lab[lab] != lab).any():
                lab[:] = lab[lab]
            a, b = lab[i], lab[j]
            live = a != b
            if not live.any():
                return
            np.minimum.at(lab, np.maximum(a, b)[live], np.minimum(a, b)[live])

    held_i, held_j, held = [], [], 0
    for a, r in enumerate(g.rows):
        inside, some = g.near(a, a)
        if len(inside):
            at = np.concatenate([g.rows[b] for b in inside])
            held_i.append(np.full(len(at), r[0])), held_j.append(at)
            held += len(at)
        if len(some):
            rows, at, close = g.pairs(a, some)
            i, j = np.nonzero(close)
            held_i.append(rows[i]), held_j.append(at[j])
            held += len(i)
        if held > BLOCK:
            join(np.concatenate(held_i), np.concatenate(held_j))
            held_i, held_j, held = [], [], 0
    if held:
        join(np.concatenate(held_i), np.concatenate(held_j))
    return lab


def _meet(x: np.ndarray, of: np.ndarray, eps: float):
    """For blocks of the rows `of`: (rows, other rows, whether they are within eps), over all rows of x that
    their leaves' boxes reach."""
    if not len(of):
        return
    parts = leaves(x, LEAF)
    low, high = (np.array([f(x[p], axis=0) for p in parts]) for f in (np.min, np.max))
    x2, limit = (x * x).sum(1), eps * eps + 1e-9
    for block in leaves(x[of], LEAF):
        rows = of[block]
        gap = np.maximum(np.maximum(low - x[rows].max(0), x[rows].min(0) - high), 0)
        some = np.flatnonzero((gap * gap).sum(1) <= limit * (1 + 1e-9))
        step = max(1, BLOCK // (LEAF * len(rows)))
        for s in range(0, len(some), step):
            at = np.concatenate([parts[i] for i in some[s : s + step]])
            yield rows, at, x2[rows, None] + x2[at] - 2 * (x[rows] @ x[at].T) <= limit


def local_dbscan(x: np.ndarray, eps: float, min_pts: int) -> np.ndarray:
    """Cluster of each row, noise 0, clusters from 1 in the order of their first core rows; a border row
    belongs to the first cluster of its core neighbours. Rows with a coordinate that isn't finite are noise.

    Rows of a cell whose diagonal is eps are neighbours, so only rows of cells with less than min_pts are
    counted. One core row of each cell links cells; then only what lies outside the largest component is
    compared with all core rows."""
    out = np.zeros(len(x), int)
    here = np.flatnonzero(np.isfinite(x).all(1)) if len(x) else np.zeros(0, int)
    if not len(here):
        return out
    x = x[here]
    x = x[:, np.ptp(x, axis=0) > 0]
    if not x.shape[1]:
        out[here] = int(len(here) >= min_pts)
        return out
    x = x - x.mean(0)
    cell = np.floor(x / (eps / np.sqrt(x.shape[1]) * (1 - 1e-9))) if eps > 0 else x
    cell = np.unique(cell, axis=0, return_inverse=True)[1].ravel()
    core = np.bincount(cell)[cell] >= min_pts
    count = np.zeros(len(x), int)
    for rows, _, close in _meet(x, np.flatnonzero(~core), eps):
        count[rows] += close.sum(1)
    core |= count >= min_pts
    ids = np.flatnonzero(core)
    if not len(ids):
        return out
    _, one, group = np.unique(cell[ids], return_index=True, return_inverse=True)
    part = _linked(x[ids[one]], eps, "euclidean")[group]
    to = np.arange(len(one))

    def root(i):
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    y = x[ids]
    for rows, at, close in _meet(y, np.flatnonzero(part != np.bincount(part).argmax()), eps):
        i, j = np.nonzero(close & (part[rows][:, None] != part[at]))
        for a, b in np.unique(np.column_stack([part[rows[i]], part[at[j]]]), axis=0):
            a, b = root(a), root(b)
            to[max(a, b)] = min(a, b)
    part = np.array([root(i) for i in range(len(to))])[part]
    first = np.full(len(to), len(x))
    np.minimum.at(first, part, ids)
    label = np.full(len(x), len(x))
    label[ids] = first[part]
    border = np.flatnonzero(~core)
    for rows, at, close in _meet(x, border, eps):
        label[rows] = np.minimum(label[rows], np.where(close & core[at], np.where(core[at], label[at], len(x)), len(x)).min(1))
    names = np.unique(first[part])
    out[here] = np.where(label < len(x), np.searchsorted(names, label) + 1, 0)
    return out


def _matrix(t: pa.Table, dims: int) -> np.ndarray:
    return np.asarray(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dims)


def neighbour_counts(points: DataFrame, dims: int, eps: float, measure: str = "euclidean", nearest: bool = True) -> DataFrame:
    """(v, w, n, nearest): n rows within eps of each vertex (its own included) and the distance to the
    nearest other vertex within eps (0 where the vertex has several rows, null without one). With a
    column ask only for the vertices where it is true. Without `nearest` that is null, and dense cells
    are counted by leaves."""

    _measure(measure)  # an unknown name fails here

    def run(batches):
        for t in whole_groups(batches, "cell"):
            key, home, w, x = t["cell"].to_numpy(), t["home"].to_numpy(zero_copy_only=False).astype(bool), t["w"].to_numpy(), _matrix(t, dims)
            ends = group_bounds(key)
            n, near = np.zeros(len(key), np.int64), np.full(len(key), np.nan)
            for a, z in zip(ends[:-1], ends[1:]):
                g = x[a:z]
                if not nearest:
                    n[a:z] = _weights_near(g, w[a:z], home[a:z], eps, measure)
                    continue
                for r, d2, close in _blocks(g, np.flatnonzero(home[a:z]), eps, measure):
                    n[a + r] = close @ w[a:z]
                    d2[np.arange(len(r)), r] = np.inf
                    d2[~close] = np.inf
                    low = d2.min(1)
                    near[a + r] = np.where(np.isfinite(low), _measure(measure)[2](low), np.nan)
            near[(w > 1) & nearest] = 0.0
            at = pa.array(np.flatnonzero(home))
            yield pa.RecordBatch.from_arrays([t["v"].combine_chunks().take(at), t["w"].combine_chunks().take(at), pa.array(n[home]), pa.array(near[home], from_pandas=True)], names=["v", "w", "n", "nearest"])

    copies = _copies(points, dims, eps)
    if "ask" in points.columns:
        copies = copies.withColumn("home", F.col("home") & F.col("ask")).drop("ask")
        copies = copies.join(copies.where("home").select("cell").distinct(), "cell", "left_semi")
    return by_key(copies, "cell").mapInArrow(run, "v array<double>, w bigint, n bigint, nearest double")


def dbscan(df: DataFrame, cols: list[str], eps: float, min_pts: int, border_as_noise: bool = False, measure: str = "euclidean") -> DataFrame:
    """df's rows with finite cols, plus cluster bigint and kind CORE, BORDER or NOISE.

    A row is core if at least min_pts rows lie within eps, itself included. Clusters are components of
    core rows within eps of each other; a border row joins the cluster of smallest id among its core
    neighbours (or is noise, as asked). Noise has cluster 0, clusters count from 1 in the order of
    their smallest core point.
    """
    spark, dims = df.sparkSession, len(cols)
    scratch = Scratch(spark, "dbscan")
    pts = scratch.table(vertices(df, cols))
    counted = neighbour_counts(pts, dims, eps, measure, nearest=False).select("v", "n")
    # vertices are named by their coordinates in order, so the smallest name is the smallest point
    named = scratch.table(counted.withColumn("core", F.col("n") >= min_pts))

    def links(batches):
        for t in whole_groups(batches, "cell"):
            key, home, core, x = t["cell"].to_numpy(), t["home"].to_numpy(zero_copy_only=False).astype(bool), t["core"].to_numpy(zero_copy_only=False).astype(bool), _matrix(t, dims)
            ends = group_bounds(key)
            a_all, b_all = [], []
            for a, z in zip(ends[:-1], ends[1:]):
                c = np.flatnonzero(core[a:z])
                if not len(c):
                    continue
                lab = _linked(x[a:z][c], eps, measure)
                a_all.append(c + a)
                b_all.append(c[lab] + a)
            if a_all:
                v = t["v"].combine_chunks()
                yield pa.RecordBatch.from_arrays([v.take(pa.array(np.concatenate(a_all))), v.take(pa.array(np.concatenate(b_all)))], names=["a", "b"])

    e = by_key(_copies(named.where("core"), dims, eps), "cell").mapInArrow(links, "a array<double>, b array<double>")
    # each cell names its parts by a member; parts are joined where a border copy lies in several
    e = scratch.table(e)
    own = e.groupBy("a").agg(F.min("b").alias("part"))
    joined = e.join(own, "a").select(F.col("part").alias("a"), F.col("b")).distinct()
    parts = connected_components(joined).select(F.col("id").alias("part"), "component")
    comp = scratch.table(own.join(parts, "part").select(F.col("a").alias("v"), "component"))
    first = comp.groupBy("component").agg(F.min("v").alias("first"))
    cores = scratch.table(comp.join(number_rows(first, ["first"], "cluster", 1).select("component", "cluster"), "component").select("v", "cluster"))
    rest = named.where("NOT core").select("v", F.lit(None).cast("bigint").alias("cluster"))

    def border(batches):
        for t in whole_groups(batches, "cell"):
            key, home, x = t["cell"].to_numpy(), t["home"].to_numpy(zero_copy_only=False).astype(bool), _matrix(t, dims)
            cl = t["cluster"].to_numpy(zero_copy_only=False)
            cl = np.where(np.isnan(cl.astype(float)), 0, cl.astype(float)).astype(np.int64)
            ends = group_bounds(key)
            at_all, got_all = [], []
            for a, z in zip(ends[:-1], ends[1:]):
                core = np.flatnonzero(cl[a:z] > 0)
                ask = np.flatnonzero((cl[a:z] == 0) & home[a:z])
                if not len(core) or not len(ask):
                    continue
                both = np.concatenate([core, ask])
                g, n = _Leaves(x[a:z][both], eps, measure), len(core)
                got = np.full(len(both), np.iinfo(np.int64).max)
                top = np.array([got[0] if (r >= n).all() else cl[a:z][both[r[r < n]]].min() for r in g.rows])
                named = np.where(np.arange(len(both)) < n, cl[a:z][both], got)
                for leaf, r in enumerate(g.rows):
                    if (r < n).all():
                        continue
                    inside, some = g.near(leaf)
                    if len(inside):
                        got[r] = top[inside].min()
                    if len(some):
                        rows, at, close = g.pairs(leaf, some)
                        got[rows] = np.minimum(got[rows], np.where(close, named[at][None, :], np.iinfo(np.int64).max).min(1))
                ok = (np.arange(len(both)) >= n) & (got < np.iinfo(np.int64).max)
                at_all.append(both[ok] + a)
                got_all.append(got[ok])
            if at_all:
                yield pa.RecordBatch.from_arrays([t["v"].combine_chunks().take(pa.array(np.concatenate(at_all))), pa.array(np.concatenate(got_all))], names=["v", "cluster"])

    edge = by_key(_copies(cores.unionByName(rest), dims, eps), "cell").mapInArrow(border, "v array<double>, cluster bigint")
    labels = cores.select("v", "cluster", F.lit("CORE").alias("kind"))
    if not border_as_noise:
        labels = labels.unionByName(edge.select("v", "cluster", F.lit("BORDER").alias("kind")))
    labels = scratch.table(labels)
    ok = F.lit(True)
    for c in cols:
        ok = ok & is_finite(F.col(c).cast("double"))
    rows = df.where(ok).withColumn("_v", F.array(*(F.col(c).cast("double") for c in cols)))
    out = rows.join(labels.withColumnRenamed("v", "_v").withColumnRenamed("cluster", "_cl").withColumnRenamed("kind", "_k"), "_v", "left")
    return out.select(*df.columns, F.coalesce("_cl", F.lit(0)).cast("bigint").alias("cluster"), F.coalesce("_k", F.lit("NOISE")).alias("kind"))


def clustered(labelled: DataFrame) -> DataFrame:
    return labelled.where("cluster > 0")


def noise(labelled: DataFrame) -> DataFrame:
    return labelled.where("cluster = 0")


def predict(labelled: DataFrame, cols: list[str], queries: DataFrame, id_col: str, eps: float, min_pts: int, border_as_noise: bool = False) -> DataFrame:
    """(id, prediction) of new points by their labelled neighbours within eps: the cluster with at least
    min_pts - 1 of them (the one with most, then the smallest id); else, where border points count, any
    cluster met (likewise); else -1 for a new cluster if at least min_pts - 1 noise rows are near; else 0.

    queries: id_col and cols. Rows meet in grid cells; counts are added up, pairs aren't kept.
    """
    dims = len(cols)
    known = labelled.groupBy(F.array(*(F.col(c).cast("double") for c in cols)).alias("v"), "cluster").agg(F.count("*").alias("w"))
    ask = queries.select(F.col(id_col).alias("id"), F.array(*(F.col(c).cast("double") for c in cols)).alias("q"))
    k = _copies(known, dims, eps).select("cell", "v", "cluster", "w")
    q = ask.withColumn("cell", F.xxhash64(*(F.floor(F.col("q")[i] / (SIDE * eps)) for i in range(min(dims, 2)))))
    near = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) <= eps * eps
    counts = q.join(k, "cell").where(near).groupBy("id", "cluster").agg(F.sum("w").alias("n"))
    per = counts.groupBy("id").agg(
        F.min(F.when((F.col("cluster") > 0) & (F.col("n") >= min_pts - 1), F.struct(-F.col("n"), "cluster"))).alias("strong"),
        F.min(F.when(F.col("cluster") > 0, F.struct(-F.col("n"), "cluster"))).alias("any"),
        F.sum(F.when(F.col("cluster") == 0, F.col("n")).otherwise(0)).alias("quiet"),
    )
    weak = F.lit(None).cast("bigint") if border_as_noise else F.col("any.cluster")
    label = F.coalesce("strong.cluster", weak, F.when(F.col("quiet") >= min_pts - 1, F.lit(-1)), F.lit(0))
    return ask.select("id").join(per, "id", "left").select("id", label.cast("bigint").alias("prediction"))


def within_eps_histogram(df: DataFrame, cols: list[str], eps: float, buckets: int = 16, measure: str = "euclidean") -> DataFrame:
    """(lo, hi, count) of the number of rows within eps of each distinct point, itself included; points
    with no other near count 0."""
    n = neighbour_counts(vertices(df, cols), len(cols), eps, measure).select(F.when(F.col("n") == 1, 0).otherwise(F.col("n")).alias("n"))
    return histogram(n, "n", buckets)


def nearest_histogram(df: DataFrame, cols: list[str], eps: float, buckets: int = 16, measure: str = "euclidean") -> DataFrame:
    """(lo, hi, count) of the distance from each distinct point to the nearest other row, looked for
    within eps; points without one are left out."""
    return histogram(neighbour_counts(vertices(df, cols), len(cols), eps, measure), "nearest", buckets)


def nearest_distances(df: DataFrame, cols: list[str], eps: float, few: int = FEW) -> DataFrame:
    """(v, w, nearest): distance of each distinct point to the nearest other row, however far; null only
    if there is no other row.

    Points without a neighbour within eps are asked again with eps doubled; the last `few` of them meet
    all points, held by every task.
    """
    dims, scratch = len(cols), Scratch(df.sparkSession, "nearest")
    pts = scratch.table(vertices(df, cols))
    got = scratch.table(neighbour_counts(pts, dims, eps).select("v", "w", "nearest"))
    done, left = got.where("nearest IS NOT NULL"), got.where("nearest IS NULL").select("v", "w")
    while left.count() > few:
        eps *= 2
        asked = pts.join(left.select("v", F.lit(True).alias("ask")), "v", "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
        got = scratch.table(neighbour_counts(asked, dims, eps).select("v", "w", "nearest"))
        done, left = done.unionByName(got.where("nearest IS NOT NULL")), got.where("nearest IS NULL").select("v", "w")
    rest = left.collect()
    if not rest:
        return done
    ask = np.array([r["v"] for r in rest], float)

    def run(batches):
        best = np.full(len(ask), np.inf)
        for b in batches:
            x = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dims)
            for s in range(0, len(x), max(1, BLOCK // len(ask))):
                part = x[s : s + max(1, BLOCK // len(ask))]
                d2 = sum((ask[:, a][:, None] - part[None, :, a]) ** 2 for a in range(dims))
                same = (ask[:, None, :] == part[None]).all(2)
                best = np.minimum(best, np.where(same, np.inf, d2).min(1))
        ok = np.flatnonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(ok, pa.int64()), pa.array(np.sqrt(best[ok]))], names=["i", "d"])

    near = pts.select("v").mapInArrow(run, "i bigint, d double").groupBy("i").agg(F.min("d").alias("nearest"))
    named = df.sparkSession.createDataFrame([(i, r["v"], r["w"]) for i, r in enumerate(rest)], "i bigint, v array<double>, w bigint")
    return done.unionByName(named.join(near, "i", "left").select("v", "w", "nearest"))


def within_eps_row_histogram(df: DataFrame, cols: list[str], eps: float, buckets: int = 16) -> DataFrame:
    """within_eps_histogram with every row counted."""
    n = neighbour_counts(vertices(df, cols), len(cols), eps).select(F.when(F.col("n") == 1, 0).otherwise(F.col("n")).alias("n"), "w")
    return histogram(n, "n", buckets, "w")


def nearest_row_histogram(df: DataFrame, cols: list[str], eps: float, buckets: int = 16) -> DataFrame:
    """(lo, hi, count) of the distance from each row to the nearest other one, however far."""
    return histogram(nearest_distances(df, cols, eps), "nearest", buckets, "w")


def even_split(cells: list[tuple[tuple[float, float, float, float], int]], most: int, size: float) -> list[tuple[tuple[float, float, float, float], int]]:
    """Parts of the bounding box of counted rectangles (x1, y1, x2, y2), the farther part of a cut first:
    each holds at most `most` points or can't be cut on the grid of `size`, and every cut is the one
    whose near side comes closest to half. Empty parts drop out. It plans by hand on a few counts."""
    if not cells:
        return []
    box, n = np.array([c for c, _ in cells], float), np.array([k for _, k in cells])

    def held(x1, y1, x2, y2):
        return int(n[(box[:, 0] >= x1) & (box[:, 1] >= y1) & (box[:, 2] <= x2) & (box[:, 3] <= y2)].sum())

    def parts(x1, y1, x2, y2):
        whole = held(x1, y1, x2, y2)
        columns = [((x1, y1, x, y2), (x, y1, x2, y2)) for x in (x1 + i * size for i in range(1, round((x2 - x1) / size)))]
        rows = [((x1, y1, x2, y), (x1, y, x2, y2)) for y in (y1 + i * size for i in range(1, round((y2 - y1) / size)))]
        if whole <= most or not columns + rows:
            return [((x1, y1, x2, y2), whole)] if whole else []
        near, far = min(columns + rows, key=lambda c: abs(whole // 2 - held(*c[0])))
        return parts(*far) + parts(*near)

    edge = [c for c, _ in cells]
    return parts(min(c[0] for c in edge), min(c[1] for c in edge), max(c[2] for c in edge), max(c[3] for c in edge))
