"""Grouping records into similarity clusters (problem 1).

1. Neighbour graph by neighbour descent. Vectors are rotated by a rotation learned on a bounded
   sample and put into wide cells of a few axes, those near a border into the cells beyond it too,
   so every pair within the distance asked for meets in a cell. A cell with more rows than the budget
   is split again, along further axes, then more finely, always with such borders. In every cell the
   graph of the k nearest neighbours is found by descent: neighbours of neighbours, forward and
   reverse, replace worse neighbours until little changes. An exact check follows: leaves of the cell
   that belong to different parts of the graph and lie near enough are compared, and missing links
   added. What is too dense to split further is cut by hash, twice, and checked in blocks.
2. Communities by modularity. Vertices first move inside their cell, where nothing has to be sent;
   the communities found there are contracted, and only these move and contract further as tables.
3. Clusters are communities that an edge links, directly or through others: a vertex only joins a
   community along an edge, so none spans two clusters. The most typical members of a cluster have the
   highest weighted degree inside their community.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracklode.functions.groups import leaves
from tracklode.llm import vectors as V
from tracklode.llm.linking import group_ids
from tracklode.llm.neighbours import _partitions
from tracklode.runtime import Scratch

#: Neighbours of a vertex, rows of a cell beyond which it is split, rows of a leaf in the exact check.
NEIGHBOURS, HEAVY, LEAF = 10, 30_000, 48
#: Width of a cell in limits, and the axes it spans.
WIDTH, AXES = 20, 3


def descend(x: np.ndarray, k: int, seed: int, rounds: int = 10, stop: float = 0.005) -> tuple[np.ndarray, np.ndarray]:
    """Approximate k nearest other rows of each row by neighbour descent: (row numbers, distances)."""
    n = len(x)
    k = min(k, n - 1)
    r = np.random.default_rng(seed)
    x = x - x.mean(0)

    def squared(rows, cand):
        return ((x[rows][:, None, :] - x[cand]) ** 2).sum(-1)

    def best(rows, cand):
        """The k best distinct candidates of each row, itself excluded."""
        cand = np.sort(cand, axis=1)
        d = squared(rows, cand)
        d[:, 1:][cand[:, 1:] == cand[:, :-1]] = np.inf
        d[cand == rows[:, None]] = np.inf
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        return np.take_along_axis(cand, at, 1), np.take_along_axis(d, at, 1)

    # starts next to each other along two seeded directions, and at random
    near = [r.integers(0, n, (n, k))]
    for _ in range(2):
        o = np.argsort(x @ r.normal(size=x.shape[1]))
        at = np.empty(n, int)
        at[o] = np.arange(n)
        near.append(o[np.clip(at[:, None] + np.array([j for j in range(-(k // 2) - 1, k // 2 + 2) if j]), 0, n - 1)])
    start = np.concatenate(near, axis=1)
    block = max(1, 4_000_000 // (start.shape[1] * x.shape[1] + 1))
    got = [best(np.arange(s, min(s + block, n)), start[s : s + block]) for s in range(0, n, block)]
    nb, d = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    for _ in range(rounds):
        # reverse neighbours, k of each vertex at most, picked at random
        src, dst = np.repeat(np.arange(n), k), nb.ravel()
        o = np.lexsort((r.random(len(dst)), dst))
        src, dst = src[o], dst[o]
        rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
        back = np.repeat(np.arange(n)[:, None], k, 1)
        ok = rank < k
        back[dst[ok], rank[ok]] = src[ok]
        both = np.concatenate([nb, back], axis=1)
        step = both[:, r.permutation(2 * k)[: max(4, k // 2)]]  # a part of the neighbours is followed each round
        block = max(1, 8_000_000 // ((k + step.shape[1] * 2 * k) * x.shape[1]))
        changed, got = 0, []
        for s in range(0, n, block):
            rows = np.arange(s, min(s + block, n))
            cand = np.concatenate([nb[rows], both[step[rows]].reshape(len(rows), -1)], axis=1)
            got.append(best(rows, cand))
            changed += int((got[-1][1].sum(1) < d[rows].sum(1) - 1e-12).sum())
        nb, d = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        if changed <= stop * n:
            break
    return nb, np.sqrt(d)


def parts_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component label (smallest row) of each of n rows under the pairs i, j."""
    lab = np.arange(n)
    while len(i):
        a, b = lab[i], lab[j]
        live = a != b
        if not live.any():
            break
        i, j, a, b = i[live], j[live], a[live], b[live]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


def local_communities(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Community label (a row number) of each of n rows after parallel modularity moves along the
    edges i, j of weight w. Half of the rows may move in a round; ties go to the own, then the smaller label."""
    lab = np.arange(n)
    if not len(i):
        return lab
    src, dst, ww = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
    k = np.bincount(src, ww, n)
    total = ww.sum() or 1.0
    turn = (np.arange(n) * 2654435761 >> 7) & 1
    for step in range(rounds):
        to = lab[dst]
        order = np.lexsort((to, src))
        a, c, x = src[order], to[order], ww[order]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
        a, c, x = a[head], c[head], np.add.reduceat(x, head)
        mass = np.bincount(lab, k, n)
        own = c == lab[a]
        gain = x - k[a] * (mass[c] - np.where(own, k[a], 0.0)) / total
        stay = -k * (mass[lab] - k) / total  # of a row without a neighbour in its own community
        stay[a[own]] = gain[own]
        best = np.lexsort((c, ~own, -np.round(gain, 9), a))
        first = best[np.flatnonzero(np.concatenate([[True], a[best][1:] != a[best][:-1]]))]
        row, move = a[first], c[first]
        ok = (gain[first] > stay[row] + 1e-9) & (turn[row] == step % 2) & (move != lab[row])
        if not ok.any() and step:
            break
        lab[row[ok]] = move[ok]
    return lab


def missing_links(x: np.ndarray, part: np.ndarray, limit: float, leaf: int = LEAF):
    """Pairs (i, j, distance) within `limit` whose rows have different parts, all of them: rows lie in
    leaves halved along the widest axis, and only leaves near each other and not of one and the same
    part are compared."""
    rows = leaves(x, leaf)
    low, high = (np.array([f(x[r], axis=0) for r in rows]) for f in (np.min, np.max))
    least, most = (np.array([f(part[r]) for r in rows]) for f in (np.min, np.max))
    out = []
    for a, r in enumerate(rows):
        gap = np.maximum(np.maximum(low[a] - high[a:], low[a:] - high[a]), 0.0)
        near = ((gap * gap).sum(1) <= limit * limit * (1 + 1e-9)) & ~((least[a:] == most[a:]) & (least[a] == most[a]) & (least[a:] == least[a]))
        met = np.flatnonzero(near) + a
        if not len(met):
            continue
        other = np.concatenate([rows[b] for b in met])
        i, j, d = V.near_pairs(x[r], x[other], limit)
        i, j = r[i], other[j]
        ok = (part[i] != part[j]) & (~np.isin(j, r) | (i < j))
        out.append((i[ok], j[ok], d[ok]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _levels(dim: int, limit: float) -> list[tuple[list[int], float]]:
    """(axes, width) of the cells and of each further split: other axes first, then finer ones."""
    groups = [list(range(s, min(s + AXES, dim))) for s in range(0, dim, AXES)]
    return [(g, w * limit) for w in (WIDTH, WIDTH / 2, WIDTH / 4) for g in groups]


def _cells(dim: int, mean, turn, limit: float, axes: list[int], width: float):
    """Rows (cell, home, id, v) under their cell inside the one they come from, and as border copies
    under those within reach."""
    reach = limit * (1 + 1e-9) + 1e-9

    def run(batches):
        for b in batches:
            y = ((V.as_matrix(b.column(3), dim) - mean) @ turn)[:, axes]
            before = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            home = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cell = np.floor(y / width).astype(np.int64)
            off = y - cell * width
            low, high = off <= reach, off >= width - reach
            for step in itertools.product((0, -1, 1), repeat=len(axes)):
                s = np.array(step)
                ok = ((s == 0) | ((s == -1) & low) | ((s == 1) & high)).all(1)
                if not ok.any():
                    continue
                h = before[ok] ^ np.uint64(0x9E3779B97F4A7C15)
                for c in (cell[ok] + s).astype(np.uint64).T:
                    h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(29)
                at = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(home[ok] & (not s.any())), b.column(2).take(at), b.column(3).take(at)], names=["cell", "home", "id", "v"])

    return run


def _graph(dim: int, k: int, limit: float, seed: int):
    """Complete cells -> rows (a, b, dist, ca, cb). With b: an edge of a, at home here; ca and cb are the
    communities of its ends, null for one that isn't at home here. Without b: the community ca of a."""

    def one(x, home, own):
        nb, nd = descend(x, k, seed)
        ok = (nd <= limit).ravel()
        i, j, d = np.repeat(np.arange(len(x)), nb.shape[1])[ok], nb.ravel()[ok], nd.ravel()[ok]
        more = missing_links(x, parts_of(len(x), i, j), limit)
        i, j, d = (np.concatenate(c) for c in zip((i, j, d), more))
        low, high = np.minimum(i, j), np.maximum(i, j)
        _, at = np.unique(low * np.int64(len(x)) + high, return_index=True)
        i, j, d = low[at], high[at], d[at]
        keep = home[i] | home[j]
        i, j, d = i[keep], j[keep], d[keep]
        inside = own[i] & own[j]
        lab = local_communities(len(x), i[inside], j[inside], 1 - d[inside] / (2 * limit))
        return i, j, d, lab

    def run(batches):
        for t in V.whole_groups(batches, "cell"):
            ends = V.group_bounds(t["cell"].to_numpy())
            x, home, own = V.as_matrix(t["v"].combine_chunks(), dim), *(t[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("home", "own"))
            ids = t["id"].to_numpy()
            a_all, b_all, d_all, ca_all, cb_all = [], [], [], [], []
            for a, z in zip(ends[:-1], ends[1:]):
                if z - a < 2 or not home[a:z].any():
                    continue
                i, j, d, lab = one(x[a:z], home[a:z], own[a:z])
                here = ids[a:z]
                com = here[lab]
                mine = np.flatnonzero(own[a:z] & np.isin(np.arange(z - a), np.concatenate([i, j])))
                a_all += [here[i], here[mine]]
                b_all += [here[j], np.full(len(mine), -1)]
                d_all += [d, np.zeros(len(mine))]
                ca_all += [np.where(own[a:z][i], com[i], -1), com[mine]]
                cb_all += [np.where(own[a:z][j], com[j], -1), np.full(len(mine), -1)]
            if a_all:
                cols = [np.concatenate(c) for c in (a_all, b_all, d_all, ca_all, cb_all)]
                yield pa.RecordBatch.from_arrays([pa.array(c, mask=None if n in (0, 2) else c < 0) for n, c in enumerate(cols)], names=["a", "b", "dist", "ca", "cb"])

    return run


def _against(dim: int, limit: float):
    """Complete blocks of probes and chunks of what is too dense to split: links between them."""

    def run(batches):
        for t in V.whole_groups(batches, "cell"):
            ends = V.group_bounds(t["cell"].to_numpy())
            x, probe = V.as_matrix(t["v"].combine_chunks(), dim), t["probe"].to_numpy(zero_copy_only=False).astype(bool)
            ids = t["id"].to_numpy()
            for a, z in zip(ends[:-1], ends[1:]):
                p, q = np.flatnonzero(probe[a:z]) + a, np.flatnonzero(~probe[a:z]) + a
                if len(p) and len(q):
                    i, j, d = V.near_pairs(x[p], x[q], limit)
                    ok = ids[p[i]] != ids[q[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[p[i][ok]]), pa.array(ids[q[j][ok]]), pa.array(d[ok])], names=["a", "b", "dist"])

    return run


def neighbour_graph(scratch: Scratch, reps: DataFrame, n: int, dim: int, limit: float, k: int = NEIGHBOURS, seed: int = 23, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices). edges (a, b, dist, ca, cb), a < b: neighbour edges within `limit` whose components
    are those of all pairs within it, with the cell communities of their ends. vertices (id, c): the cell
    community of each vertex that has an edge. reps: id bigint, v."""
    spark = reps.sparkSession
    mean, turn = V.fit_rotation(reps, n, dim, seed)
    kind = "cell bigint, home boolean, id bigint, v array<double>"
    rows = reps.select(F.lit(0).cast("bigint").alias("cell"), F.lit(True).alias("home"), "id", "v")
    ready, levels = None, _levels(dim, limit)
    for axes, width in levels:
        cells = rows.mapInArrow(_cells(dim, mean, turn, limit, axes, width), kind)
        if n <= heavy:  # no cell can hold more
            ready = cells if ready is None else ready.unionByName(cells)
            rows = None
            break
        cells = scratch.table(cells)
        counts = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > heavy)
        hot = scratch.table(counts)
        done = cells.join(hot, "cell", "left_anti")
        ready = done if ready is None else ready.unionByName(done)
        if hot.isEmpty():
            rows = None
            break
        rows = scratch.table(cells.join(hot.select("cell"), "cell", "left_semi"))

    def graph(t):
        by_cell = t.repartition(_partitions(spark), "cell").sortWithinPartitions("cell", "id")
        return by_cell.mapInArrow(_graph(dim, k, limit, seed), "a bigint, b bigint, dist double, ca bigint, cb bigint")

    inside = None
    if rows is None:
        made = scratch.table(graph(ready.withColumn("own", F.col("home"))))
    else:  # too dense to split: hash chunks, twice, so that chunks overlap
        inside = rows.join(hot, "cell").withColumn("chunks", F.ceil(F.col("n") * 2 / heavy))
        cut = [inside.select(F.xxhash64("cell", F.lit(salt), F.pmod(F.xxhash64("id", F.lit(salt)), "chunks")).alias("cell"), "home", "id", "v", (F.col("home") & F.lit(salt == 1)).alias("own")) for salt in (1, 2)]
        made = scratch.table(graph(ready.withColumn("own", F.col("home")).unionByName(cut[0]).unionByName(cut[1])))
    vertices = made.where("b IS NULL").select(F.col("a").alias("id"), F.col("ca").alias("c"))
    found = made.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist", F.when(F.col("a") < F.col("b"), F.col("ca")).otherwise(F.col("cb")).alias("ca"), F.when(F.col("a") < F.col("b"), F.col("cb")).otherwise(F.col("ca")).alias("cb"))
    # an edge with both ends at home in one cell is there once; the others may come from both cells
    own, cross = found.where("ca IS NOT NULL AND cb IS NOT NULL"), found.where("ca IS NULL OR cb IS NULL").select("a", "b", "dist")
    if inside is not None:
        # exact check of the densest cells: what lies outside the largest part of a cell against all of it
        part = group_ids(found, "a", "b").select(F.col("rid").cast("bigint").alias("id"), F.col("group_rid").alias("part"))
        held = inside.join(part, "id", "left").withColumn("part", F.coalesce("part", F.col("id").cast("string")))
        sizes = held.groupBy("cell", "part").count().groupBy("cell").agg(F.max_by("part", F.struct("count", "part")).alias("most"), F.sum("count").alias("all"), F.max("count").alias("largest"))
        # blocks of the rest meet chunks of the whole, so no task holds more than one of each
        blocks = sizes.select("cell", "most", F.ceil((F.col("all") - F.col("largest")) * 2 / heavy).alias("blocks")).where("blocks > 0")
        sized = scratch.table(held.join(blocks, "cell"))
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
        rest = sized.where("part <> most").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), "blocks")).withColumn("chunk", upto("chunks")).withColumn("probe", F.lit(True))
        whole = sized.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(4)), "chunks")).withColumn("block", upto("blocks")).withColumn("probe", F.lit(False))
        both = rest.unionByName(whole).select(F.xxhash64("cell", "block", "chunk").alias("cell"), "probe", "id", "v")
        more = both.repartition(_partitions(spark), "cell").sortWithinPartitions("cell").mapInArrow(_against(dim, limit), "a bigint, b bigint, dist double")
        known = found.where("ca IS NOT NULL AND cb IS NOT NULL").select("a", "b")
        extra = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist")
        cross = cross.unionByName(scratch.table(extra.distinct()).join(known, ["a", "b"], "left_anti"))
    once = cross.groupBy("a", "b").agg(F.min("dist").alias("dist"))
    ends = once.join(vertices.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a", "left").join(vertices.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b", "left")
    named = ends.select("a", "b", "dist", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    return scratch.table(own.unionByName(named)), vertices


def communities(scratch: Scratch, edges: DataFrame, rounds: tuple[int, ...] = (4, 4, 3)) -> DataFrame:
    """(id, c) of every vertex of (a, b, w): its community after parallel modularity moves.

    rounds: moves before and after each contraction. A vertex moves to the neighbouring community of
    greatest gain if that beats its own; half of the vertices may move in a round, so two neighbours
    don't change places. Ties go to the smaller name.
    """
    sym = scratch.table(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w")))
    whole = None
    for stage, moves in enumerate(rounds):
        label = sym.groupBy("src").agg(F.sum("w").alias("k")).select(F.col("src").alias("id"), F.col("src").alias("c"), "k")
        total = sym.agg(F.sum("w")).collect()[0][0] or 1.0
        for step in range(moves):
            to = sym.where("src <> dst").join(label.select(F.col("id").alias("dst"), "c"), "dst").groupBy("src", "c").agg(F.sum("w").alias("in"))
            mass = label.groupBy("c").agg(F.sum("k").alias("mass"))
            own = label.select(F.col("id").alias("src"), F.col("c").alias("mine"), "k")
            stay = own.select("src", F.col("mine").alias("c"), F.lit(0.0).alias("in"))
            options = to.unionByName(stay).groupBy("src", "c").agg(F.sum("in").alias("in")).join(own, "src").join(mass, "c")
            gain = F.col("in") - F.col("k") * (F.col("mass") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / total
            may = F.pmod(F.xxhash64("src", F.lit(step), F.lit(stage)), F.lit(2)) == 0
            pick = options.select("src", "c", "mine", "k", gain.alias("gain")).where((F.col("c") == F.col("mine")) | may)
            # the largest gain; on ties the own community, then the smaller name
            best = pick.groupBy("src").agg(F.first("k").alias("k"), F.min(F.struct(-F.round("gain", 9), F.col("c") != F.col("mine"), "c")).alias("m"))
            moved = scratch.table(best.select(F.col("src").alias("id"), F.col("m.c").alias("c"), "k"))
            scratch.drop(label)
            label = moved
        if whole is None:
            whole = label.select("id", "c")
        else:
            whole = whole.join(label.select(F.col("id").alias("c"), F.col("c").alias("_up")), "c", "left").select("id", F.coalesce("_up", "c").alias("c"))
        if stage + 1 < len(rounds):
            to = label.select(F.col("id").alias("src"), F.col("c").alias("cs"))
            up = label.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
            joined = scratch.table(sym.join(to, "src").join(up, "dst").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w")))
            scratch.drop(sym)
            sym = joined
    return scratch.table(whole)


def _clustered(points: DataFrame, dim: int, limit: float, least: int, **graph):
    """Steps 1 to 3 over distinct vectors: points, vectors, edges, communities, clusters."""
    scratch = Scratch(points.sparkSession, "clusters")
    pts = scratch.table(V.usable(points, dim))
    reps = scratch.table(V.classes(pts).withColumn("id", F.monotonically_increasing_id()))
    edges, vertices = neighbour_graph(scratch, reps, reps.count(), dim, limit, **graph)
    edges = edges.withColumn("w", 1 - F.col("dist") / F.lit(2 * limit))
    # communities of the cells are contracted: sums of edge weights inside and between them
    inner = scratch.table(edges.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
    com = communities(scratch, inner).select(F.col("id").alias("c0"), "c")
    joined = group_ids(inner.where("a <> b"), "a", "b").select(F.col("rid").cast("bigint").alias("c0"), F.col("group_rid").cast("bigint").alias("g"))
    named = scratch.table(com.join(joined, "c0", "left").select("c0", "c", F.coalesce("g", "c0").alias("g")))
    of = scratch.table(vertices.withColumnRenamed("c", "c0").join(named, "c0", "left").select("id", "c0", F.coalesce("c", "c0").alias("c"), F.coalesce("g", "c0").alias("g")))
    vertex = scratch.table(reps.select("id", "rep", "n").join(of, "id", "left").select("id", "rep", "n", F.coalesce("c", "id").alias("c"), F.coalesce("g", "id").alias("g")))
    clusters = vertex.groupBy("g").agg(F.sum("n").alias("n_rids"), F.min("rep").alias("cluster_rid")).where(F.col("n_rids") >= least)
    return pts, reps, edges, named, vertex, scratch.table(clusters)


def cluster_members(points: DataFrame, dim: int = 16, limit: float = 1.0, least: int = 8, **graph) -> DataFrame:
    """(rid, cluster_rid): records joined by steps of at most `limit`, in clusters of `least` rids up.

    points has rid and features; unusable vectors are left out as in vectors.usable, repeated rids
    count once, equal vectors under different rids are joined. Records of smaller clusters are left
    out; an empty table gives no rows. cluster_rid is the smallest rid of the cluster.
    """
    pts, reps, _, _, vertex, clusters = _clustered(points, dim, limit, least, **graph)
    of = vertex.join(clusters, "g").select("rep", "n", "cluster_rid")
    single = of.where("n = 1").select(F.col("rep").alias("rid"), "cluster_rid")
    copies = pts.join(reps.where("n > 1").select("v", "rep"), "v").join(of.select("rep", "cluster_rid"), "rep").select("rid", "cluster_rid")
    return single.unionByName(copies)


def cluster_summary(points: DataFrame, dim: int = 16, limit: float = 1.0, least: int = 8, typical: int = 5, **graph) -> DataFrame:
    """(cluster_rid, n_rids, n_communities, typical array<string>): the clusters of cluster_members,
    with the rids of highest weighted degree inside their community (ties: the smaller rid)."""
    _, _, edges, named, vertex, clusters = _clustered(points, dim, limit, least, **graph)
    # both ends in one community: most edges lie inside a community of a cell already
    up = named.select("c0", "c")
    between = edges.where("ca <> cb").join(up.select(F.col("c0").alias("ca"), F.col("c").alias("xa")), "ca").join(up.select(F.col("c0").alias("cb"), F.col("c").alias("xb")), "cb").where("xa = xb").select("a", "b", "w")
    inside = edges.where("ca = cb").select("a", "b", "w").unionByName(between)
    degree = inside.select(F.explode(F.array("a", "b")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("degree"))
    ranked = vertex.join(degree, "id", "left").join(clusters.select("g", "cluster_rid"), "g").select("cluster_rid", "rep", F.round(F.coalesce("degree", F.lit(0.0)), 9).alias("degree"))
    top = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_rid").orderBy(F.desc("degree"), "rep"))).where(F.col("_r") <= typical)
    names = top.groupBy("cluster_rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "rep"))), lambda e: e["rep"]).alias("typical"))
    n = vertex.groupBy("g").agg(F.count_distinct("c").alias("n_communities"))
    return clusters.join(n, "g").join(names, "cluster_rid").select("cluster_rid", "n_rids", "n_communities", "typical")
