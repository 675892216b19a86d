"""Clusters and nearest vectors against brute force, heavy paths included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklode.llm import communities, neighbours
from tracklode.llm import vectors as V

SCHEMA = "rid string, features array<double>, v int, rep string, cell bigint, key bigint, n int"


def _points(seed=0):
    """Blobs of uneven density, a chain, copies, and every kind of unusable row."""
    r = np.random.default_rng(seed)
    rows = []
    for b, (n, s) in enumerate([(300, 0.15), (40, 0.2), (9, 0.1), (7, 0.05), (60, 3.0)]):
        c = r.normal(size=16) * 50
        rows += [(f"b{b}-{i}", (c + r.normal(size=16) * s).tolist()) for i in range(n)]
    base = r.normal(size=16) * 50
    rows += [(f"chain{i}", (base + np.eye(16)[0] * 0.9 * i).tolist()) for i in range(12)]
    same = (r.normal(size=16) * 50).tolist()
    rows += [(f"same{i:02d}", same) for i in range(15)]
    rows += [rows[0], rows[5]]
    bad = [None, [], [1.0] * 15, [1.0] * 17, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")]]
    return rows + [(f"bad{i}", v) for i, v in enumerate(bad)] + [(None, [0.0] * 16)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, 4) for i, v in rows], SCHEMA)


def _usable(rows):
    good = {i: v for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v)}
    ids = sorted(good)
    return ids, np.array([good[i] for i in ids])


def _brute_nearest(rows, k=5, limit=2.5):
    ids, x = _usable(rows)
    pairs = set()
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[:k]  # ids are sorted, so ties go to the smaller one
        pairs |= {tuple(sorted((ids[i], ids[j]))) for j in near if d[j] <= limit}
    return pairs


def _brute_clusters(rows, limit=1.0, least=8):
    ids, x = _usable(rows)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= limit
    lab = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.array([lab[d[i]].min() for i in range(len(ids))])
        if (new == lab).all():
            break
        lab = new
    out = {}
    for c in set(lab):
        m = [ids[i] for i in np.flatnonzero(lab == c)]
        if len(m) >= least:
            out |= {i: min(m) for i in m}
    return out


def test_nearest_pairs_equal_brute_force(spark):
    rows = _points()
    got = {tuple(r) for r in neighbours.neighbour_pairs(_frame(spark, rows)).collect()}
    assert got == _brute_nearest(rows)


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5])
def test_nearest_recall_with_second_codes(spark, seed):
    rows = _points(seed)
    got = {tuple(r) for r in neighbours.neighbour_pairs(_frame(spark, rows), heavy=60, leaf=30).collect()}
    want = _brute_nearest(rows)
    assert len(got & want) / len(want) >= 0.97


def test_second_codes_of_a_dense_blob(spark):
    """One blob of 3,000 vectors, cut into leaves of about 200, their codes fitted on a part of it."""
    x = np.random.default_rng(7).normal(size=(3_000, 16)) * 0.3
    rows = [(f"d{i:05d}", v.tolist()) for i, v in enumerate(x)]
    got = {tuple(r) for r in neighbours.neighbour_pairs(_frame(spark, rows), heavy=400, leaf=200, sample=500).collect()}
    want = _brute_nearest(rows)
    assert len(got & want) / len(want) >= 0.97
    r = neighbours.measured_recall(_frame(spark, rows), F.xxhash64("rid") % 50 == 0, heavy=400, leaf=200, sample=500).head()
    assert r.n_queries > 30 and r.n_true == 5 * r.n_queries and r.n_found >= 0.95 * r.n_true


def test_measured_recall_equals_brute_force(spark):
    rows = _points(2)
    r = neighbours.measured_recall(_frame(spark, rows), F.lit(True)).head()
    ids, x = _usable(rows)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert r.n_queries == len(ids) and r.n_true == int(np.minimum((d <= 2.5).sum(1) - 1, 5).sum()) == r.n_found


def test_copies_name_the_smallest_others(spark):
    rows = [(f"s{i}", [1.0] * 16) for i in range(8)]
    got = {(r.rid, r.other) for r in neighbours.nearest_records(_frame(spark, rows)).collect()}
    assert {o for i, o in got if i == "s7"} == {"s0", "s1", "s2", "s3", "s4"}
    assert {o for i, o in got if i == "s0"} == {"s1", "s2", "s3", "s4", "s5"}


@pytest.mark.parametrize("heavy", [communities.HEAVY, 200, 80])
def test_clusters_equal_brute_force(spark, heavy):
    rows = _points()
    got = {r.rid: r.cluster_rid for r in communities.cluster_members(_frame(spark, rows), heavy=heavy).collect()}
    assert got == _brute_clusters(rows)


def test_cluster_summary(spark):
    rows = _points()
    want = _brute_clusters(rows)
    for r in communities.cluster_summary(_frame(spark, rows)).collect():
        members = {i for i, c in want.items() if c == r.cluster_rid}
        assert r.n_rids == len(members) and set(r.typical) <= members and len(r.typical) == len(set(r.typical)) > 0


def test_empty_tables(spark):
    e = _frame(spark, [("bad", None)]).where("false")
    assert communities.cluster_members(e).count() == 0
    assert communities.cluster_summary(e).count() == 0
    assert neighbours.neighbour_pairs(e).count() == 0


def test_descent_recall():
    x = np.random.default_rng(3).normal(size=(3000, 8))
    nb, d = communities.descend(x, 10, 1)
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    true = np.argpartition(d2, 9, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(nb, true)]) > 0.9
    assert np.allclose(d, np.sqrt(np.take_along_axis(d2, nb, 1)))


def test_descent_recall_in_uneven_density():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(n, 16)) * sd + r.normal(size=16) * 20 for n, sd in ((900, 0.2), (300, 1.0), (80, 0.1), (400, 4.0))])
    nb, _ = communities.descend(x, 10, 1)
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    true = np.argpartition(d2, 9, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(nb, true)]) > 0.9


def test_missing_links_are_those_of_brute_force():
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(150, 4)), r.normal(size=(60, 4)) * 0.3 + 2])
    part = r.integers(0, 3, len(x))
    i, j, d = communities.missing_links(x, part, 0.7, leaf=16)
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(a, b) for a in range(len(x)) for b in range(a) if full[a, b] <= 0.7 and part[a] != part[b]}
    assert {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


def test_local_communities_of_two_cliques():
    pairs = [(g * 6 + i, g * 6 + j) for g in range(2) for i in range(6) for j in range(i)] + [(0, 6)]
    i, j = (np.array(c) for c in zip(*pairs))
    lab = communities.local_communities(12, i, j, np.ones(len(i)))
    assert len(set(lab[:6])) == 1 == len(set(lab[6:])) and lab[0] != lab[6]


def test_communities_of_two_cliques(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0", 0.5)]
    from tracklode.runtime import Scratch

    com = {r.id: r.c for r in communities.communities(Scratch(spark, "t"), spark.createDataFrame(edges, "a string, b string, w double"), rounds=(6, 3)).collect()}
    assert len({com[f"a{i}"] for i in range(6)}) == 1 and len({com[f"b{i}"] for i in range(6)}) == 1


def test_near_pairs_ties_go_to_the_first():
    x = np.array([[0.0, 0], [1, 0], [0, 1], [-1, 0], [0, -1]])
    i, j, d = V.near_pairs(x[:1], x[1:], 2.0, 2)
    assert j.tolist() == [0, 1] and d.tolist() == [1.0, 1.0]
