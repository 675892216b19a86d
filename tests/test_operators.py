"""Core operators on small fixtures with known answers and against brute force."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklode.functions import arrays as A
from tracklode.functions.ids import number_rows
from tracklode.operators import areas, density, grid, hotspot, kmeans, lsh, meanshift, profile, sequences, skew
from tracklode.operators import dbscan as db
from tracklode.operators import graph
from tracklode.plans import catalog


# ---- skew ----


def _buckets(spark, rows):
    return spark.createDataFrame(rows, "rid string, entry int, hashValue bigint, part int, n_rows int")


def test_bucket_counts(spark):
    r = random.Random(1)
    rows = [(f"r{r.randrange(400)}", 0, 7, 1, 2) for _ in range(2000)] + [(f"r{r.randrange(60)}", r.randrange(3), r.randrange(5), 1, 2) for _ in range(800)]
    rows += [("same", 1, 9, 0, 0)] * 500 + [(None, 1, 1, 0, 0), ("x", None, 1, 0, 0), ("x", 1, None, 0, 0)]
    want = {}
    for rid, e, h, *_ in rows:
        if rid is not None and e is not None and h is not None:
            want.setdefault((e, h), []).append(rid)
    for n in (1, 3, 16):
        got = {(x.entry, x.hashValue): (x.n_rows, x.n_rids) for x in skew.bucket_counts(_buckets(spark, rows), n).collect()}
        assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
    heavy = {tuple(x) for x in skew.heavy_keys(_buckets(spark, rows), 0.05).collect()}
    total = sum(len(set(v)) for v in want.values())
    assert heavy == {k for k, v in want.items() if len(set(v)) >= 0.05 * total}


def test_bucket_counts_of_nothing(spark):
    assert skew.bucket_counts(_buckets(spark, [])).count() == 0 and skew.heavy_keys(_buckets(spark, [])).count() == 0


# ---- arrays and distances ----


def _one(spark, col, **arrays):
    return spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{k} array<double>" for k in arrays)).select(col.alias("r")).head()[0]


def test_distances(spark):
    v = {"a": [1.0, 2.0, 2.0], "b": [2.0, 0.0, 1.0]}
    cos = 4 / (3 * math.sqrt(5))
    assert _one(spark, A.squared_euclidean("a", "b"), **v) == 6
    assert _one(spark, A.cosine("a", "b"), **v) == pytest.approx(1 - cos)
    x, y = np.outer(v["a"], v["a"]), np.outer(v["b"], v["b"])
    full = 1 - np.trace(x @ y) / math.sqrt(np.trace(x @ x) * np.trace(y @ y))
    assert _one(spark, A.rv("a", "b"), **v) == pytest.approx(full)
    assert _one(spark, A.rv("a", "b"), a=[0.0, 0.0], b=[1.0, 1.0]) == 1
    m = np.random.default_rng(0).normal(size=(2, 6, 6))
    p, q = (t + t.T for t in m)
    assert _one(spark, A.rv_flat("a", "b"), a=p.ravel().tolist(), b=q.ravel().tolist()) == pytest.approx(np.trace(p @ q) / math.sqrt(np.trace(p @ p) * np.trace(q @ q)))
    assert _one(spark, A.jaccard("a", "b"), a=[1.0, 2.0], b=[2.0, 3.0]) == pytest.approx(2 / 3)
    assert _one(spark, A.jaccard("a", "b"), a=[], b=[]) is None
    with pytest.raises(ValueError):
        A.distance("nope")


def test_vector_algebra(spark):
    v = {"a": [4.0, 1.0, 9.0]}
    assert _one(spark, A.sqrt("a"), **v) == [2, 1, 3]
    assert _one(spark, A.sub_from(10, "a"), **v) == [6, 9, 1]
    assert _one(spark, A.div_from(36, "a"), **v) == [9, 36, 4]
    assert _one(spark, A.least_index("a"), **v) == 1 and _one(spark, A.largest_index("a"), **v) == 2
    assert _one(spark, A.add(A.power("a", 2), A.steps(1, 3)), **v) == [17, 3, 84]
    assert _one(spark, A.div("a", A.zeros(3)), **v) == [None] * 3
    assert _one(spark, A.total(A.ones(4)), **v) == 4


# ---- profiles ----


def test_profile_of_dirty_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "a"), (float("nan"), None), (float("inf"), "a")], "x double, s string")
    r = profile.numeric_stats(df, ["x"]).head()
    assert (r["min"], r["max"], r["count"], r["mean"], r["std"]) == (1, 3, 2, 2, 1)
    assert [tuple(x) for x in profile.lexicon(df, ["s"]).orderBy("id").collect()] == [("s", "a", 0, 3), ("s", "b", 1, 1)]
    assert {x.combo: x["count"] for x in profile.nominal_combos(df, []).collect()} == {"": 5}
    assert profile.numeric_stats(df.where("false"), ["x"]).head()["min"] is None


def test_bins_scaling_and_one_hot(spark):
    df = spark.createDataFrame([(0, 0.0, "u", 5.0), (1, 2.0, "v", 5.0), (2, 4.0, None, 5.0)], "i int, x double, s string, c double")
    assert [r.bin_x for r in profile.std_bins(df, ["x"]).orderBy("i").collect()] == [0, 1, 2]
    assert [r.bin_c for r in profile.std_bins(df, ["c"]).collect()] == [None] * 3
    assert [r.scaled_c for r in profile.min_max_scaled(df, ["c"]).collect()] == [0, 0, 0]
    assert [r.active for r in profile.active_indexes(df, ["x"], ["s"]).orderBy("i").collect()] == [[0, 3], [1, 4], [2]]
    # one-hot that keeps the last value: three-wide vectors, one active index each
    two = spark.createDataFrame([(0, "0"), (1, "2"), (2, "1"), (3, "0"), (4, "0"), (5, "2")], "i int, s string")
    assert [r.active for r in profile.active_indexes(two, [], ["s"]).orderBy("i").collect()] == [[0], [2], [1], [0], [0], [2]]


def test_histogram(spark):
    df = spark.createDataFrame([(float(i),) for i in range(33)] + [(None,)], "x double")
    h = profile.histogram(df, "x", 16).orderBy("lo").collect()
    assert len(h) == 16 and sum(r["count"] for r in h) == 33 and h[-1]["count"] == 3 and h[-1].hi == 32
    assert [tuple(r) for r in profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect()] == [(2, 2, 2)]
    assert profile.histogram(df.where("false"), "x").count() == 0


def test_dense_ids(spark):
    t = number_rows(spark.range(1000).repartition(7), ["id"], "n", 1)
    assert t.where("n <> id + 1").count() == 0 and t.count() == 1000


def test_cells(spark):
    df = spark.createDataFrame([(0.0, -1.0), (9.9, 3.0), (10.0, None)], "x double, y double")
    assert [r.cell for r in grid.offset_cells(df, {"x": 5, "y": 2}).orderBy("x").collect()] == [[0, 0], [1, 2], None]
    assert [r.cell for r in grid.ceil_cells(df, {"x": 5}).orderBy("x").collect()] == [[0], [2], [2]]
    x, y, t = (c.alias(n) for c, n in zip(grid.from_linear(F.lit(3 + 4 * 7 + 5 * 7 * 6), 7, 6), "xyt"))
    assert tuple(spark.range(1).select(x, y, t).head()) == (3, 4, 5)
    n = spark.range(1).select(F.size(grid.neighbours(F.array(F.lit(1), F.lit(1), F.lit(1)), 3)), F.size(grid.neighbours(F.array(F.lit(1), F.lit(1)), 2, box=False))).head()
    assert tuple(n) == (27, 5)


# ---- graphs ----


def test_components_of_known_graphs(spark):
    def comp(edges):
        return {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}

    assert comp([(1, 3)]) == {1: 1, 3: 1}
    assert comp([(1, 3), (3, 4), (5, 5), (6, None)]) == {1: 1, 3: 1, 4: 1, 5: 5}
    assert comp([]) == {}


def test_components_by_contraction(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", 0)
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(600, 680)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(80)]
    got = {x.id: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}


def test_reachability(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (3, 3)], "u int, v int")
    assert {tuple(r) for r in graph.reach(e, spark.createDataFrame([(1,), (4,)], "seed int")).collect()} == {(1, 1), (1, 2), (1, 3), (4, 4), (4, 3)}
    v = spark.createDataFrame([(i, 10 - i) for i in (1, 2, 3, 4)], "v int, rank int")
    assert {r.v: r.label.v for r in graph.least_ancestor(e, v).collect()} == {1: 1, 2: 2, 3: 4, 4: 4}


# ---- min-hash ----

SETS = [("a0", [0, 1, 2]), ("a1", [2, 3, 4]), ("a2", [0, 2, 4]), ("b0", [1, 3, 5]), ("b1", [2, 3, 5]), ("b2", [1, 2, 4])]


def test_min_hash_join_and_search(spark):
    df = spark.createDataFrame(SETS + [("copy", [2, 1, 0, 0]), ("none", None), ("empty", [])], "id string, active array<int>")
    ab = lsh.coefficients(5, 12345)
    classes, member = lsh.set_classes(df, "id")
    assert classes.count() == 6 and {r.class_id for r in member.where("id = 'copy'").collect()} == {"a0"}
    sets = dict(SETS)
    for r in lsh.bucket_join(classes, ab, 0.6).collect():
        a, b = set(sets[r.id_a]), set(sets[r.id_b])
        assert r.dist == pytest.approx(1 - len(a & b) / len(a | b)) and r.dist < 0.6
    for r in classes.withColumn("h", lsh.min_hash("active", ab)).collect():
        assert r.h == [min(((1 + e) * a + b) % lsh.PRIME for e in r.active) for a, b in ab]
    near = lsh.approx_nearest(classes, [1, 3], 2, ab, multi_probe=True).collect()
    assert len(near) == 2 and [r.dist for r in near] == sorted(r.dist for r in near)
    with_bucket = {r.rid: r.area_id for r in areas.min_hash_areas(df, "id", "active", ab).collect()}
    assert set(with_bucket.values()) >= {1} and with_bucket["copy"] == with_bucket["a0"]


def test_single_dimension_areas_are_bins(spark):
    df = profile.active_indexes(spark.range(60).select("id", (F.col("id") % 6).cast("double").alias("x")), ["x"], [])
    got = {r.rid: r.area_id for r in areas.discover("MINHASHLSH", df, "id", active="active", ab=lsh.coefficients(3, 1)).collect()}
    bins = {r.id: r.bin_x for r in profile.std_bins(df.select("id", "x"), ["x"]).collect()}
    assert len({(got[i], bins[i]) for i in got}) == len(set(bins.values())) == len(set(got.values()))


# ---- density ----


def _brute_dbscan(pts, eps, least):
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= least
    lab = np.where(core, np.arange(len(pts)), 10**9)
    for _ in range(len(pts)):
        new = np.array([min([lab[i], *lab[d[i] & core]]) if core[i] else lab[i] for i in range(len(pts))])
        if (new == lab).all():
            break
        lab = new
    kind = ["CORE" if c else "BORDER" if (d[i] & core).any() else "NOISE" for i, c in enumerate(core)]
    return kind, lab, core, d


@pytest.mark.parametrize("dims", [2, 3])
def test_dbscan_equals_brute_force(spark, dims):
    r = np.random.default_rng(dims)
    pts = np.concatenate([r.normal(size=(80, dims)) * 0.4, r.normal(size=(60, dims)) * 0.4 + 4, r.uniform(-3, 8, size=(60, dims)), np.full((3, dims), 1.0)])
    cols = ["x", "y", "z"][:dims]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)] + [(900, *[None] * dims), (901, *[float("nan")] * dims)], "cell int, " + ", ".join(f"{c} double" for c in cols))
    got = {x.cell: x for x in db.dbscan(df, cols, 0.6, 5).collect()}
    kind, lab, core, d = _brute_dbscan(pts, 0.6, 5)
    assert [got[i].kind for i in range(len(pts))] == kind and len(got) == len(pts)
    names = {}
    for i in np.flatnonzero(core):
        assert names.setdefault(lab[i], got[i].cluster) == got[i].cluster
    assert len(set(names.values())) == len(names)
    for i, k in enumerate(kind):
        if k == "BORDER":
            assert got[i].cluster == min(got[j].cluster for j in np.flatnonzero(d[i] & core))
    assert {x.kind for x in db.dbscan(df, cols, 0.6, 5, border_as_noise=True).collect()} == {"CORE", "NOISE"}
    assert db.dbscan(df.where("false"), cols, 0.6, 5).count() == 0
    assert db.clustered(db.dbscan(df, cols, 0.6, 5)).count() + db.noise(db.dbscan(df, cols, 0.6, 5)).count() == len(pts)


def test_dbscan_prediction(spark):
    lab = spark.createDataFrame([(0.0, 0.0, 1), (0.1, 0.0, 1), (0.0, 0.1, 1), (5.0, 5.0, 2), (9.0, 9.0, 0), (9.1, 9.0, 0)], "x double, y double, cluster bigint")
    q = spark.createDataFrame([(1, 0.05, 0.05), (2, 5.1, 5.0), (3, 9.0, 9.1), (4, 50.0, 50.0)], "id int, x double, y double")
    want = {1: 1, 2: 2, 3: -1, 4: 0}
    assert {r.id: r.prediction for r in db.predict(lab, ["x", "y"], q, "id", 0.5, 3).collect()} == want
    assert {r.id: r.prediction for r in db.predict(lab, ["x", "y"], q, "id", 0.5, 3, border_as_noise=True).collect()} == want | {2: 0}


def test_even_split():
    six = [((0, 0, 1, 1), 3), ((0, 2, 1, 3), 6), ((1, 1, 2, 2), 7), ((1, 0, 2, 1), 2), ((2, 0, 3, 1), 5), ((2, 2, 3, 3), 4)]
    assert db.even_split(six, 9, 1) == [((1, 2, 3, 3), 4), ((0, 2, 1, 3), 6), ((0, 1, 3, 2), 7), ((2, 0, 3, 1), 5), ((0, 0, 2, 1), 5)]
    assert db.even_split([((0, 0, 1, 1), 3), ((2, 2, 3, 3), 4), ((0, 1, 1, 2), 2)], 4, 1)[:2] == [((1, 0, 3, 3), 4), ((0, 1, 1, 3), 2)]


@pytest.mark.parametrize("small", [graph.SMALL, 0])
def test_density_clusters_follow_the_seed_order(spark, monkeypatch, small):
    monkeypatch.setattr(density, "SMALL", small)
    r = random.Random(4)
    cells = {(x, y): r.randint(1, 9) for x in range(7) for y in range(7) if r.random() < 0.6}
    df = spark.createDataFrame([(list(c), n) for c, n in cells.items()], "cell array<bigint>, n bigint")
    got = {}
    for x in density.density_clusters(df, 2, 0.8, 2, 1).collect():
        got.setdefault(x.cluster, set()).add(tuple(x.cell))
    clusters = []
    for c in sorted(cells, key=lambda c: (cells[c], c)):
        if cells[c] >= 2 and not any(c in k for k in clusters):
            todo, seen = [c], {c}
            while todo:
                u = todo.pop()
                for v in cells:
                    if v not in seen and max(abs(u[0] - v[0]), abs(u[1] - v[1])) <= 1 and cells[v] >= 0.8 * cells[u] and cells[v] >= 2:
                        seen.add(v)
                        todo.append(v)
            clusters.append(seen)
    assert got == {i + 1: k for i, k in enumerate(k for k in clusters if len(k) > 1)}


# ---- k-means and mean shift ----


def _blobs(spark, dim=4, n=40):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(n, dim)) * 0.1 + 5 * np.eye(dim)[i] for i in range(3)])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")


@pytest.mark.parametrize("name", ["euclidean", "cosine", "RV"])
def test_kmeans_finds_blobs(spark, name):
    x, pts = _blobs(spark)
    centers, cost, _ = kmeans.kmeans(pts, 3, 4, name, seed=3)
    lab = {r.id: r.cluster for r in kmeans.nearest_centroid(pts, centers, name).collect()}
    assert len({tuple(lab[i] for i in range(k * 40, k * 40 + 40)) for k in range(3)}) == 3
    assert all(len({lab[i] for i in range(k * 40, k * 40 + 40)}) == 1 for k in range(3)) and cost >= 0


@pytest.mark.parametrize("name", kmeans.MEASURES)
def test_bisecting(spark, name):
    x, pts = _blobs(spark)
    if name == "jaccard":
        pts = pts.select("id", F.transform("v", lambda e: F.when(e > 2, 1.0).otherwise(0.0)).alias("v"))
    nodes, assigned = kmeans.bisecting(pts, 3, 4, name, iterations=6)
    leaves = kmeans.leaf_nodes(nodes)
    assert 2 <= len(leaves) <= 3 and sum(n["size"] for n in leaves) == 120 and assigned.count() == 120
    assert sorted(n["leaf"] for n in leaves) == list(range(len(leaves)))
    by = {n["node"]: n for n in nodes}
    assert all(by[n["parent"]]["size"] == by[2 * n["parent"]]["size"] + by[2 * n["parent"] + 1]["size"] for n in nodes if n["node"] > 1)
    if name == "euclidean":
        leaf = {r.id: r.leaf for r in kmeans.predict(nodes, pts).collect()}
        number = {n["node"]: n["leaf"] for n in leaves}
        assert all(leaf[r.id] == number[r.node] for r in assigned.collect())
        assert number[kmeans.predict_path(nodes, x[0].tolist())[-1]] == leaf[0]
    with pytest.raises(ValueError):
        kmeans.bisecting(pts, 0, 4)


def test_local_kmeans():
    x = np.array([[1.0, 0], [2.0, 0.1], [0, 1.0], [0.1, 3.0]])
    c = np.array(kmeans.local_kmeans(x, np.ones(4), 2, 1))
    near = kmeans._np_distance("RV", x, c).argmin(1)
    assert near[0] == near[1] != near[2] == near[3]


def test_mean_shift_lsh_fixtures(spark):
    pts = spark.createDataFrame([("a", [1.0] * 3), ("b", [2.0] * 3), ("c", [3.0] * 3)], "id string, v array<double>")
    for steps in (1, 5):
        m = meanshift.mean_shift_lsh(pts, 3, k=1, epsilon1=100, epsilon2=100, epsilon3=100, cmin=0, iterations=steps, slices=1, label_slices=1)
        r = m["centers"].collect()
        assert len(r) == 1 and r[0].center == pytest.approx([2, 2, 2]) and r[0]["size"] == 3
        assert {x.cluster for x in m["labels"].collect()} == {0}
    m = meanshift.mean_shift_lsh(pts, 3, k=1, epsilon1=1e-6, epsilon2=1e-6, epsilon3=0, cmin=0, iterations=1, slices=1, label_slices=1)
    at = meanshift.predict(m["centers"], spark.createDataFrame([("q", [0.5] * 3)], "id string, v array<double>")).head().cluster
    assert [r.center for r in m["centers"].collect() if r.cluster == at][0] == pytest.approx([1, 1, 1])
    assert meanshift.image_analysis(m).count() == 3
    with pytest.raises(ValueError):
        meanshift.mean_shift_lsh(pts, 3, cmin=10)
    with pytest.raises(ValueError):
        meanshift.mean_shift_lsh(pts, 3, k=7, slices=3, cmin=1)


def test_local_mean_shift():
    x = np.array([[0.0], [0.1], [0.2], [10.0], [10.1]])
    assert meanshift.local_mean_shift(x, 1.0, 0.5).tolist() == [0, 0, 0, 1, 1]
    assert meanshift.local_mean_shift(x, 100.0, 0.5).tolist() == [0] * 5


# ---- sequences ----


def _visits(spark, rows):
    df = spark.createDataFrame([(t, s, a, float(s or 0), 0.0, 0.0) for t, s, a in rows], "traj bigint, t bigint, area int, x double, y double, z double")
    return sequences.visits(df, "traj", "t", "area", ["x", "y", "z"])


def test_worked_example(spark):
    ev = _visits(spark, [(1, 0, 1), (1, 50, 2), (1, 200, 1), (1, 230, 2), (2, 0, 1), (2, 500, 2), (2, 500, 0), (None, 1, 1), (3, None, 1)])
    p = sequences.gap_patterns(ev, 0.5, 100)
    assert [(r.pattern, r.length, r.support) for r in p.collect()] == [([1, 2], 2, 1)]
    inst = sequences.pattern_instances(ev, p, 100, 3)
    assert [(r.traj, r.times) for r in inst.collect()] == [(1, [0, 50, 200, 230])]
    tr = sequences.transitions(inst).orderBy("n").collect()
    assert [r.v for r in tr] == [[0, 0, 0, 50, 0, 0], [200, 0, 0, 230, 0, 0]]
    c = sequences.cluster_transitions(sequences.transitions(inst), 10.0, 1.0).collect()
    assert {r.cluster for r in c} == {0, 1}
    assert {r.text for r in sequences.transition_text(sequences.cluster_transitions(sequences.transitions(inst), 10.0, 1.0)).collect()} == {"1-0.0,0.0,0.0,50.0,0.0,0.0", "1-200.0,0.0,0.0,230.0,0.0,0.0"}


def test_transition_density_clusters(spark):
    rows = [("1,2", 2, t, n, [x, 0.0]) for t, n, x in ((1, 0, 0.0), (1, 1, 1.0), (2, 0, 2.0), (3, 0, 50.0), (4, 0, 100.0), (5, 0, 100.5), (6, 0, 101.0))] + [("3,4", 2, 1, 0, [0.0, 0.0])]
    tr = spark.createDataFrame(rows, "pattern string, length int, traj bigint, n int, v array<double>")
    got = {(r.pattern, r.traj, r.v[0]): r.cluster for r in sequences.cluster_transitions_dbscan(tr, 1.2, 3).collect()}
    assert [got["1,2", t, x] for t, x in ((1, 0.0), (1, 1.0), (2, 2.0), (3, 50.0), (4, 100.0), (5, 100.5), (6, 101.0))] == [1, 1, 1, 0, 2, 2, 2] and got["3,4", 1, 0.0] == 0
    pts = spark.createDataFrame([(i, [float(i % 2) * 10 + i * 0.01, 1.0]) for i in range(40)], "id int, v array<double>")
    lab = {r.id: r.cluster for r in sequences.cluster_vectors(pts, 2, slices=2, label_slices=1).collect()}
    assert len({lab[i] for i in range(0, 40, 2)}) == 1 == len({lab[i] for i in range(1, 40, 2)}) and lab[0] != lab[1]


def test_block_distances(spark):
    from tracklode.operators import pairs

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)] + [(None, [1.0, 1.0]), (99, None)], "id int, v array<double>")
    got = {(r.id1, r.id2): r.dist for r in pairs.block_distances(df.where("id % 10 = 0"), df, "euclidean", block=1, once=True).collect()}
    assert got == {(i, j): float(j - i) for i in (0, 10, 20) for j in range(i, 30)}


def test_gap_patterns_equal_brute_force(spark):
    r = random.Random(6)
    rows = [(t, s, r.randint(1, 3)) for t in range(8) for s in r.sample(range(60), 9)]
    got = {tuple(x.pattern): x.support for x in sequences.gap_patterns(_visits(spark, rows), 0.5, 12, 4).collect()}
    want = {}
    per = {t: sorted((s, a) for u, s, a in rows if u == t) for t in range(8)}

    def has(seq, p, last=None):
        return not p or any(a == p[0] and (last is None or 0 < s - last <= 12) and has(seq, p[1:], s) for s, a in seq)

    import itertools

    for k in (2, 3, 4):
        for p in itertools.product((1, 2, 3), repeat=k):
            n = sum(has(per[t], p) for t in per)
            if n >= 4:
                want[p] = n
    assert got == want
    assert all(got[p[:-1]] >= n for p, n in got.items() if len(p) > 2)


def test_pattern_parameters(spark):
    ev = _visits(spark, [(1, 1, 1)])
    for bad in ({"min_support": 2, "max_gap": 1}, {"min_support": 0.1, "max_gap": -1}, {"min_support": 0.1, "max_gap": 1, "max_length": 0}):
        with pytest.raises(ValueError):
            sequences.gap_patterns(ev, **bad)
    assert sequences.gap_patterns(ev.where("false"), 0.5, 10).count() == 0


def test_merge_instances():
    item = lambda *t: [(x, (float(x),)) for x in t]
    assert [i[0] for i in sequences.merge_instances(item(0, 200), item(50, 230), 1, 100)] == [0, 50, 200, 230]
    assert sequences.merge_instances(item(0), item(500), 1, 100) == []


# ---- hotspots ----


def test_ring_sums():
    assert [n for n, _ in hotspot.ring_sums(3)] == [1, 26, 98, 218] == [1] + [24 * i * i + 2 for i in (1, 2, 3)]


def test_gi_star_equals_brute_force(spark):
    r = random.Random(7)
    pts = [(f"k{r.randrange(4)}", r.uniform(0, 5), r.uniform(0, 4), r.randrange(0, 6000)) for _ in range(150)] + [("n", None, 1.0, 1), ("n", float("nan"), 1.0, 1)]
    df = hotspot.usable(spark.createDataFrame(pts, "key string, x double, y double, ts bigint"), "key", "x", "y", "ts")
    e = hotspot.extent(df, 1.0, 1000)
    att = {x.cell_id: x.x for x in hotspot.dwell(df, e).collect()}
    got = {x.cell_id: x.z for x in hotspot.gi_star(hotspot.dwell(df, e), e, 2).collect()}
    grid_x = np.zeros((e.nx, e.ny, e.nt))
    for c, v in att.items():
        grid_x[c % e.nx, c // e.nx % e.ny, c // (e.nx * e.ny)] = v
    n, m, s = e.cells, grid_x.mean(), grid_x.std()
    for c, z in got.items():
        x, y, t = c % e.nx, c // e.nx % e.ny, c // (e.nx * e.ny)
        w1 = w2 = wx = 0.0
        for i in range(max(0, x - 2), min(e.nx, x + 3)):
            for j in range(max(0, y - 2), min(e.ny, y + 3)):
                for k in range(max(0, t - 2), min(e.nt, t + 3)):
                    ring = max(abs(i - x), abs(j - y), abs(k - t))
                    w = 1.0 if ring == 0 else 2.0 ** (1 - ring)
                    w1, w2, wx = w1 + w, w2 + w * w, wx + w * grid_x[i, j, k]
        assert z == pytest.approx((wx - m * w1) / (s * math.sqrt((n * w2 - w1 * w1) / (n - 1))))
    with pytest.raises(hotspot.DataError):
        hotspot.extent(df.where("false"), 1.0, 1000)
    with pytest.raises(hotspot.RangeError):
        hotspot.extent(df, 0, 1000)


def test_unknown_area_method(spark):
    with pytest.raises(ValueError):
        areas.discover("NOPE", spark.range(1), "id")


def test_gap_patterns_of_any_length(spark):
    # 30 trajectories walk 1 … 7 with pauses of at most 10; 900 is long and is cut at its pauses
    rows = [(t, 10 * k, k + 1) for t in range(30) for k in range(7)] + [(900, 1000 * j + 9 * k, k + 1) for j in range(20) for k in range(7)]
    ev = _visits(spark, rows)
    whole, cut = ({tuple(x.pattern): x.support for x in sequences.gap_patterns(ev, 0.9, 10, 100, long=n).collect()} for n in (10_000, 20))
    # every step is exactly 10 (9 in the long one), so only neighbours follow each other
    assert whole == cut == {tuple(range(a, z + 1)): 31 for a in range(1, 8) for z in range(a + 1, 8)}


def test_pattern_pipeline_is_not_cut_by_length(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    rows = catalog.pattern_pipeline(spark, sf).collect()
    lengths = [r.length for r in rows]
    assert {n: lengths.count(n) for n in (4, 5, 6)} == {4: 440, 5: 255, 6: 59} and max(lengths) == 6 and len(lengths) == 1220
    # every pattern went through instances, transitions and mean shift
    assert all(0 <= r.n_unplaced <= r.n_transitions and r.n_clusters <= r.n_transitions - r.n_unplaced for r in rows)
    assert sum(r.n_transitions > 0 and r.n_clusters > 0 for r in rows) > 1000 and sum(r.n_unplaced for r in rows) > 0


def test_local_mean_shift_with_missing_coordinates_and_many_parts():
    r = np.random.default_rng(5)
    x = np.array([[0.0, 0.0], [900.0, 0.0], [0.0, 900.0]])[r.integers(0, 3, 700)] + r.normal(0, 5, (700, 2))
    want = meanshift.local_mean_shift(x, 100.0, 0.001)
    assert set(want) == {0, 1, 2} and all(len(set(want[(np.abs(x - m) < 50).all(1)])) == 1 for m in ([0, 0], [900, 0], [0, 900]))
    holes = np.insert(x, [0, 350, 700], [[np.nan, 0.0], [1.0, np.inf], [np.nan, np.nan]], axis=0)
    got = meanshift.local_mean_shift(holes, 100.0, 0.001)
    assert (got[~np.isfinite(holes).all(1)] == -1).all() and (got[np.isfinite(holes).all(1)] == want).all()


def test_rv_queries_meet_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    ids = [r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()]
    got = {(r.id1, r.id2) for r in catalog.QUERIES["rv_query_distances"](spark, sf).collect()}
    assert got == {(q, i) for q in ids if q % 50 == 0 for i in ids}


def test_transition_vectors_of_every_length(spark):
    r = np.random.default_rng(8)
    rows = [(n, f"{n}-{i}", list(map(float, np.tile([0.0, 0.0, 0.0] if i % 2 else [50.0, 50.0, 0.0], n) + r.normal(0, 0.1, 3 * n)))) for n, m in ((2, 200), (3, 40), (4, 2)) for i in range(m)]
    got = sequences.cluster_vectors_by_length(spark.createDataFrame(rows, "length int, id string, v array<double>"), 3, iterations=3).collect()
    assert sorted((x.length, x.id) for x in got) == sorted(x[:2] for x in rows)
    for n in (2, 3):
        sides = [{x.cluster for x in got if x.length == n and int(x.id.split("-")[1]) % 2 == side} for side in (0, 1)]
        assert not sides[0] & sides[1]


def test_transition_vectors_query_keeps_all_transitions(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    got = {(x.length, x.id) for x in catalog.transition_vectors(spark, sf).collect()}
    want = {(x.length, f"{x.pattern}|{x.traj}|{x.n}") for x in catalog.transitions(spark, sf).select("length", "pattern", "traj", "n").collect()}
    assert got == want and {n for n, _ in got} == {2, 3}


def test_nearest_rows_however_far(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 0.2, (60, 2)), r.uniform(-40, 40, (40, 2)), [[5000.0, 5000.0]], np.full((30, 2), 1.0)])
    df = spark.createDataFrame([tuple(map(float, p)) for p in x], "x double, y double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    n = (d <= 0.5).sum(1)
    np.fill_diagonal(d, np.inf)
    want = d.min(1)
    for few in (0, 5, 1_000):
        got = {tuple(p.v): (p.w, p.nearest) for p in db.nearest_distances(df, ["x", "y"], 0.5, few).collect()}
        assert all(got[tuple(p)][1] == pytest.approx(w) for p, w in zip(x, want)) and sum(w for w, _ in got.values()) == len(x)
    h = [p["count"] for p in db.nearest_row_histogram(df, ["x", "y"], 0.5).orderBy("lo").collect()]
    assert h == np.histogram(want, 16)[0].tolist() and sum(h) == len(x)
    assert [p["count"] for p in db.within_eps_row_histogram(df, ["x", "y"], 0.5).orderBy("lo").collect()] == np.histogram(np.where(n == 1, 0, n), 16)[0].tolist()


# ---- joins of two tables, costs, measures, several labellings ----


def test_join_of_two_set_tables(spark, monkeypatch):
    import random

    monkeypatch.setattr(lsh, "CHUNK", 7)  # buckets are cut into chunks
    r = random.Random(3)
    make = lambda n, off: [(off + i, sorted(r.sample(range(12), r.randint(2, 5)))) for i in range(n)]
    a, b = make(60, 0), make(40, 1000)
    left, right = (lsh.set_classes(spark.createDataFrame(t, "id bigint, active array<int>"), "id")[0] for t in (a, b))
    ab = lsh.coefficients(4, 5)
    got = {(x.id_a, x.id_b, x.entry): round(x.dist, 9) for x in lsh.join(left, right, ab, 0.7).collect()}
    first = lambda t: {tuple(s): min(i for i, q in t if q == s) for _, s in t}
    h = lambda s, k: min(((1 + e) * ab[k][0] + ab[k][1]) % lsh.PRIME for e in s)
    want = {}
    for s, i in first(a).items():
        for t, j in first(b).items():
            d = 1 - len(set(s) & set(t)) / len(set(s) | set(t))
            want |= {(i, j, k): round(d, 9) for k in range(4) if d < 0.7 and h(s, k) == h(t, k)}
    assert got == want and want
    assert lsh.join(left.where("false"), right, ab, 0.7).count() == 0


def test_pairwise_cost(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, 5.0), ("a", 3.0, 5.0), ("b", 1e6, 1.0), ("b", 1e6 + 1, 1.0), ("c", 1.0, None)]
    got = {r.g: (r.n, round(r.cost, 6)) for r in profile.pairwise_cost(spark.createDataFrame(rows, "g string, x double, y double"), "g", ["x", "y"]).collect()}
    assert got == {"a": (3, 26.0), "b": (2, 1.0)}


@pytest.mark.parametrize("measure,norm", [("manhattan", lambda d: np.abs(d).sum(-1)), ("chebyshev", lambda d: np.abs(d).max(-1))])
def test_other_measures(spark, measure, norm):
    x = np.random.default_rng(4).uniform(0, 6, (150, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, x double, y double")
    n = {tuple(r.v): (r.n, r.nearest) for r in db.neighbour_counts(db.vertices(df, ["x", "y"]), 2, 0.5, measure).collect()}
    d = norm(x[:, None] - x[None])
    other = np.where(np.eye(len(x), dtype=bool), np.inf, d).min(1)
    for i, v in enumerate(x):
        got = n[tuple(v)]
        assert got[0] == (d[i] <= 0.5).sum() and (got[1] is None) == (other[i] > 0.5) and (got[1] is None or abs(got[1] - other[i]) < 1e-9)
    assert db.dbscan(df, ["x", "y"], 0.5, 3, measure=measure).count() == 150
    with pytest.raises(ValueError):
        db.neighbour_counts(db.vertices(df, ["x", "y"]), 2, 0.5, "cosine").count()


def test_measures_can_be_added(spark):
    from tracklode.functions import arrays as A

    A.register("first_axis", lambda a, b: F.abs(F.element_at(a, 1) - F.element_at(b, 1)))
    try:
        with pytest.raises(ValueError):
            A.register("first_axis", A.euclidean)
        df = spark.createDataFrame([([1.0, 5.0], [4.0, 9.0])], "a array<double>, b array<double>")
        assert tuple(df.select(*(A.distance(n)(F.col("a"), F.col("b")) for n in ("first_axis", "manhattan", "chebyshev"))).head()) == (3.0, 7.0, 4.0)
    finally:
        del A.DISTANCES["first_axis"]


def test_several_labellings_and_slices(spark):
    x = np.random.default_rng(6)
    pts = spark.createDataFrame([(i, (x.normal(size=2) * 0.02 + [i % 3 * 5, i % 2 * 5]).tolist()) for i in range(120)], "id bigint, v array<double>")
    m = meanshift.mean_shift_lsh(pts, 2, k=5, slices=3, label_slices=4, label_models=2, iterations=4)
    assert len(m["models"]) == 2
    for model in m["models"]:
        lab = {r.id: r.cluster for r in model["labels"].collect()}
        assert len(set(lab.values())) == 6 and all((lab[i] == lab[j]) == (i % 6 == j % 6) for i in range(0, 120, 7) for j in range(120))


def test_merged_means():
    means = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    assert meanshift._merged(means, np.array([4, 4, 4, 4, 1]), 0.05, 0).tolist() == [0, 0, 1, 1, 2]
    assert meanshift._merged(means, np.array([4, 4, 4, 4, 1]), 0.05, 1).tolist() == [0, 0, 1, 1, 1]


def test_a_dense_cell(spark):
    """100,000 points in a few cells: counts and links go by leaves."""
    x = np.random.default_rng(9).uniform(0, 3, (100_000, 2))
    import time

    began = time.time()
    n = db._weights_near(x, np.ones(len(x), int), np.ones(len(x), bool), 1.0, "euclidean")
    lab = db._linked(x[:30_000], 0.05, "euclidean")
    assert time.time() - began < 120  # all pairs would take far longer
    at = np.random.default_rng(1).choice(len(x), 200)
    assert all(n[i] == (((x - x[i]) ** 2).sum(1) <= 1.0).sum() for i in at)
    assert len(np.unique(lab)) == 1
    y = np.random.default_rng(2).uniform(0, 3, (700, 2))
    close = ((y[:, None] - y[None]) ** 2).sum(-1) <= 0.09**2
    want = np.arange(len(y))
    while True:
        low = np.where(close, want, len(y)).min(1)
        if (low == want).all():
            break
        want = low
    got = db._linked(y, 0.09, "euclidean")
    assert len(set(zip(got.tolist(), want.tolist()))) == len(set(want.tolist())) == len(set(got.tolist()))


def test_mean_shift_compares_only_the_shell(spark):
    """Less work than a few looks at all pairs of rows (F1: an iteration took one each), and the same clusters."""
    import time

    r = np.random.default_rng(3)
    at = r.normal(0, 1, (12_000, 2)) * [3_700, 4_400]
    x = np.column_stack([at, np.zeros(len(at)), at + r.normal(0, 300, at.shape), np.zeros(len(at))])

    def all_pairs():
        c = np.empty_like(x)
        for s in range(0, len(x), 256):
            near = ((x[s : s + 256] ** 2).sum(1)[:, None] + (x * x).sum(1) - 2 * (x[s : s + 256] @ x.T) <= 1e8).astype(float)
            c[s : s + 256] = near @ x / near.sum(1)[:, None]
        return c

    began = time.process_time()
    all_pairs()
    once, began = time.process_time() - began, time.process_time()
    got = meanshift.local_mean_shift(x, 10_000.0, 0.001)
    assert time.process_time() - began < 3 * once
    assert (got >= 0).all()
    few = x[:900]
    c = few.copy()
    for _ in range(100):
        near = (((c[:, None] - few[None]) ** 2).sum(2) <= 1e8).astype(float)
        c, before = near @ few / near.sum(1)[:, None], c
        if (np.abs(c - before).sum(1) <= 1e-4).all():
            break
    label, n = np.full(len(few), -1), 0
    for i in range(len(few)):
        if label[i] < 0:
            label[(label < 0) & (((c - c[i]) ** 2).sum(1) < 1e-6)] = n
            n += 1
    assert (meanshift.local_mean_shift(few, 10_000.0, 0.001) == label).all()


def test_equal_rows_are_one_cluster():
    assert meanshift.local_mean_shift(np.ones((5, 3)), 1.0, 0.1).tolist() == [0] * 5


def test_instances_at_equal_times(spark):
    ev = _visits(spark, [(1, 0, 1), (1, 0, 2), (1, 5, 2), (1, 5, 1), (1, 9, 2), (2, 3, 1), (2, 4, 2), (2, 4, 3), (None, 1, 1)])
    p = spark.createDataFrame([([1, 2],), ([1, 2, 3],), ([2, 1, 2],), ([1],)], "pattern array<int>").withColumn("length", F.size("pattern"))
    got = {(r.pattern, r.traj): (r.times, [x[0] for x in r.points]) for r in sequences.pattern_instances(ev, p, 10, 3).collect()}
    by = {1: {1: [0, 5], 2: [0, 5, 9]}, 2: {1: [3], 2: [4], 3: [4]}}
    want = {}
    for traj, own in by.items():
        for pattern in ((1, 2), (1, 2, 3), (2, 1, 2)):
            inst = [(t,) for t in own.get(pattern[0], [])]
            for k in range(1, len(pattern)):
                inst = sequences.merge_instances(inst, [(t,) for t in own.get(pattern[k], [])], k, 10) if inst else []
            if inst:
                want[",".join(map(str, pattern)), traj] = ([i[0] for i in inst], [float(i[0]) for i in inst])
    assert got == want and ("1,2", 2) in got


def test_local_dbscan():
    """The labels of the definition, and less work than one look at all pairs (F2: four and more)."""
    import time

    def brute(x, eps, min_pts):
        d = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps + 1e-9
        core = d.sum(1) >= min_pts
        label, n = np.zeros(len(x), int), 0
        for i in np.flatnonzero(core):
            if not label[i]:
                n, todo = n + 1, [i]
                label[i] = n
                while todo:
                    for j in np.flatnonzero(d[todo.pop()] & (label == 0) & core):
                        label[j] = n
                        todo.append(j)
        for i in np.flatnonzero(~core):
            label[i] = min(label[d[i] & core], default=0)
        return label.tolist()

    r = np.random.default_rng(1)
    for i in range(60):
        x = r.normal(0, r.uniform(0.3, 3), (int(r.integers(1, 250)), int(r.integers(1, 5))))
        eps, min_pts = r.uniform(0.05, 1.5), int(r.integers(1, 6))
        assert db.local_dbscan(x, eps, min_pts).tolist() == brute(x, eps, min_pts)
    holes = np.array([[0.0, 1.0], [np.nan, 0.0], [0.1, 1.0], [0.0, 1.1], [9.0, 9.0]])
    assert db.local_dbscan(holes, 0.5, 3).tolist() == [1, 0, 1, 1, 0]
    assert db.local_dbscan(np.ones((3, 2)), 0.5, 3).tolist() == [1] * 3 and db.local_dbscan(np.ones((2, 2)), 0.5, 3).tolist() == [0] * 2

    x = np.column_stack([r.normal(0, 50, 15_000), r.uniform(0, 100, 15_000), r.normal(0, 50, 15_000), r.uniform(0, 100, 15_000)])
    began = time.process_time()
    for s in range(0, len(x), 256):
        ((x[s : s + 256] ** 2).sum(1)[:, None] + (x * x).sum(1) - 2 * (x[s : s + 256] @ x.T) <= 1600).sum(1)
    once, began = time.process_time() - began, time.process_time()
    db.local_dbscan(x, 40.0, 3)
    assert time.process_time() - began < once


def test_transitions_without_a_coordinate_are_noise(spark):
    rows = [("1,2", 2, t, 0, v) for t, v in ((1, [0.0, 0.0]), (2, [0.5, 0.0]), (3, [1.0, None]), (4, [0.0, 0.5]))]
    tr = spark.createDataFrame(rows, "pattern string, length int, traj bigint, n int, v array<double>")
    got = {r.traj: (r.cluster, r.v) for r in sequences.cluster_transitions_dbscan(tr, 1.0, 3).collect()}
    assert {t: c for t, (c, _) in got.items()} == {1: 1, 2: 1, 3: 0, 4: 1} and got[3][1] == [1.0, None]


def test_nearest_rows_of_a_slice():
    """The rows that all pairs give, in less than half of their time (F3: each step took all pairs of a slice)."""
    import time

    r = np.random.default_rng(1)
    pairs = lambda m, x: (m**2).sum(1)[:, None] + (x**2).sum(1) - 2 * m @ x.T
    for i in range(60):
        n, d = int(r.integers(6, 400)), int(r.integers(1, 6))
        x = np.round(r.random((n, d)) * 4) / 4 if i % 3 == 0 else r.random((n, d))
        m, k = x[r.permutation(n)] + (0.25 if i % 2 else 0), int(r.integers(1, 6))
        assert (meanshift._nearest_rows(m, x, k) == meanshift._nearest(pairs(m, x), k)).all()
    assert meanshift._nearest_rows(np.ones((40, 2)), np.ones((40, 2)), 3).tolist() == [[0, 1, 2]] * 40
    x = np.column_stack([r.exponential(0.1, 15_000), r.integers(0, 100, 15_000) / 99, r.exponential(0.1, 15_000), r.integers(0, 100, 15_000) / 99])
    began = time.process_time()
    want = np.concatenate([meanshift._nearest(pairs(x[s : s + 266], x), 5) for s in range(0, len(x), 266)])
    once, began = time.process_time() - began, time.process_time()
    got = meanshift._nearest_rows(x, x, 5)
    took = time.process_time() - began
    print("all pairs", once, "leaves", took)
    assert (got == want).all() and took < once / 2


def test_pipeline_clusters_move_no_transitions(spark):
    """The rows of cluster_transitions, made where they are clustered (F1: all transitions went through a shuffle)."""
    from tracklode.plans import pipeline

    r = np.random.default_rng(4)
    rows = [(t, int(k), float(100 * r.integers(0, 4)), float(r.normal(0, 30)) if r.random() > 0.1 else None, 0.0) for t in range(9, 21) for k in np.cumsum(r.integers(1, 400, 60))]
    points = spark.createDataFrame(rows, "d_0 bigint, d_1 bigint, d_2 double, d_3 double, d_4 double")
    run = pipeline.mine(points, "CELLS", {"numeric": {"d_2": 100.0}}, max_gap=300, max_length=3, bandwidth=60.0, merge_window=1.0)
    key = lambda x: (x.pattern, x.length, x.traj, x.cluster, [(v is None, v) for v in x.v])
    got, want = (sorted(map(key, c.collect())) for c in (run.clusters, sequences.cluster_transitions(run.transitions, 60.0, 1.0)))
    assert got == want and len({x[0] for x in got}) > 20 and {-1, 0, 1} < {x[3] for x in got}
    plan = run.clusters._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and run.clusters.rdd.getNumPartitions() > 4
    assert run.clusters.where("pattern IS NOT NULL AND traj IS NOT NULL").rdd.getNumPartitions() > 4
    named = sequences.visits(points.withColumn("d_0", F.concat(F.lit("t"), "d_0")).withColumn("a", (F.col("d_2") / 100).cast("int")), "d_0", "d_1", "a", ["d_2", "d_3"])
    patterns = spark.createDataFrame([([1, 2], 2), ([1, 2, 1], 3), ([3], 1)], "pattern array<int>, length int")
    want = sequences.cluster_transitions(sequences.transitions(sequences.pattern_instances(named, patterns, 300, 2)), 60.0, 1.0)
    assert sorted(map(key, sequences.cluster_patterns(named, patterns, 300, 60.0, 1.0).collect())) == sorted(map(key, want.collect())) != []
    assert sequences.cluster_patterns(named, patterns.where("length = 1"), 300).count() == 0


def test_shares_of_patterns():
    todo = [(a, b, *c) for a in range(4) for b in range(5) for c in ((), (1,), (1, 2))]
    shares = sequences._shares(todo, {p: 10 + 100 * (p == (0, 0)) for p in todo}, 6)
    assert len(shares) == 6 and sorted(p for x in shares for p in x) == sorted(todo) and max(map(len, shares)) < 20
    assert sequences._shares([(1, 2)], {(1, 2): 5}, 8) == [[(1, 2)]]
