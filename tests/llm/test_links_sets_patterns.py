"""Groups of matches, set joins and subsequences against brute force."""

import bisect
import math
import random
from collections import defaultdict

import pytest

from tracklode.llm import linking, setjoin, subsequences


def _groups(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        else:
            for x in (a, b):
                if x is not None:
                    root(x)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("finish", [linking.FINISH_EDGES, 5])
def test_groups(spark, finish):
    r = random.Random(1)
    pairs = [(f"c{i},{i}", f"c{i + 1},{i + 1}") for i in range(60)]  # a chain
    pairs += [("hub,0", f"leaf,{i}") for i in range(80)] + [(f"r{r.randrange(120)}", f"r{r.randrange(120)}") for _ in range(90)]
    pairs += [("self,1", "self,1"), ("lone,1", None), (None, "lone,2"), (None, None), pairs[0], pairs[0][::-1]]
    df = spark.createDataFrame([(a, b, None, "x") for a, b in pairs], "rid_a string, rid_b string, dist_col double, id string")
    got = {x.rid: x.group_rid for x in linking.group_ids(df, finish_edges=finish).collect()}
    assert got == _groups(pairs)


def test_groups_of_nothing(spark):
    e = spark.createDataFrame([], "rid_a string, rid_b string")
    assert linking.group_ids(e).count() == 0
    lone = spark.createDataFrame([("a", None)], "rid_a string, rid_b string")
    assert [tuple(r) for r in linking.group_ids(lone).collect()] == [("a", "a")]


def _sets(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = {min(int(r.paretovariate(0.6)), 5000) for _ in range(r.randint(1, 30))}
        out.append((f"s{i}", sorted(s)))
        if r.random() < 0.4:  # a close variant
            v = set(s) - {r.choice(sorted(s))} | {r.randrange(5000)}
            out.append((f"s{i}v", sorted(v)))
    out += [("copy1", out[3][1]), ("copy2", out[3][1][::-1] + out[3][1][:1])]
    return out


def _brute_pairs(left, right, t=0.6):
    rows = [(i, frozenset(x for x in s or [] if x is not None), k) for k, part in ((0, left), (1, right)) for i, s in part if i is not None]
    rows = [x for x in rows if x[1]]
    first = {}
    for i, s, k in rows:
        first.setdefault(i, (s, k))
    ids = sorted(first)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if not (first[a][1] and first[b][1]) and len(first[a][0] & first[b][0]) / len(first[a][0] | first[b][0]) >= t}


SCHEMA = "rid string, features array<int>, sig bigint, id bigint, s string, size int"


def test_set_pairs_equal_brute_force(spark):
    left, right = _sets(1, 250), [(f"a{i}", s) for i, (_, s) in enumerate(_sets(1, 40))]
    left = left + [("none", None), ("empty", []), ("nulls", [None, None]), ("part", [None, *left[0][1], left[0][1][0]]), (None, [1, 2]), left[5]]
    df = lambda rows: spark.createDataFrame([(i, s, 1, 2, "z", 3) for i, s in rows], SCHEMA)
    got = {tuple(r) for r in setjoin.similar_pairs(df(left), df(right)).collect()}
    want = _brute_pairs(left, right)
    assert got == want and len(want) > 50
    links = {r.rid: r for r in setjoin.similarity_links(df(left), df(right)).collect()}
    assert links["copy1"].n_class == links["copy2"].n_class >= 3 and "none" not in links


def test_frequent_signatures_are_split(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "FREQUENT", 0.0)
    left = _sets(4, 150) + [(f"m{i}", [1, 2, 3, 4, 5, 6, 1000 + i]) for i in range(60)]
    df = spark.createDataFrame(left, "rid string, features array<int>")
    assert {tuple(r) for r in setjoin.similar_pairs(df).collect()} == _brute_pairs(left, [])


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_other_thresholds(spark, threshold):
    left = _sets(2, 120)
    df = spark.createDataFrame(left, "rid string, features array<int>")
    assert {tuple(r) for r in setjoin.similar_pairs(df, None, threshold).collect()} == _brute_pairs(left, [], threshold)


def test_set_pairs_of_nothing(spark):
    e = spark.createDataFrame([], "rid string, features array<int>")
    assert setjoin.similar_pairs(e, e).count() == 0 and setjoin.similarity_links(e).count() == 0


def _brute_patterns(rows, share, gap):
    seqs = defaultdict(set)
    for d, items in rows:
        if d is not None:
            seqs[d]
            for i in items or []:
                if i is not None and i[0] is not None and i[0] >= 0 and i[1] is not None and i[1] > 0:
                    seqs[d].add(i)
    need = max(1, math.ceil(share * len(seqs) - 1e-9))
    occ = {d: defaultdict(list) for d in seqs}
    for d, s in seqs.items():
        for t, a in sorted(s):
            occ[d][a].append(t)
    out = {}

    def grow(p, ends):
        cand = defaultdict(dict)
        for d, e in ends.items():
            for a, ts in occ[d].items():
                ok = [t for t in ts if (j := bisect.bisect_left(e, t) - 1) >= 0 and t - e[j] <= gap]
                if ok:
                    cand[a][d] = ok
        for a, x in cand.items():
            if len(x) >= need:
                out[p + (a,)] = len(x)
                grow(p + (a,), x)

    for a in {a for o in occ.values() for a in o}:
        x = {d: o[a] for d, o in occ.items() if a in o}
        if len(x) >= need:
            grow((a,), x)
    return out


@pytest.mark.parametrize("options", [{}, {"long": 3, "window_steps": 1}, {"long": 8, "window_steps": 2}])
def test_patterns_equal_brute_force(spark, options):
    r = random.Random(5)
    rows = [(d, [(r.randrange(0, 4000), r.randint(1, 5)) for _ in range(r.randint(0, 15))]) for d in range(40)]
    rows += [(0, rows[0][1]), (1, [(5, 1), (805, 2), (806, 3)]), (2, None), (3, [None, (None, 1), (-1, 2), (7, None), (9, 0)]), (None, [(1, 1), (2, 2)]), (99, [])]
    df = spark.createDataFrame([(d, i, "x", 1) for d, i in rows], "d_0 bigint, items array<struct<time bigint, area_id int>>, win string, n int")
    got = {tuple(map(int, x.pattern.split(","))): x.support for x in subsequences.frequent_patterns(df, 0.15, 800, **options).collect()}
    assert got == _brute_patterns(rows, 0.15, 800) and len(got) > 5


def test_patterns_of_nothing(spark):
    e = spark.createDataFrame([], "d_0 bigint, items array<struct<time bigint, area_id int>>")
    assert subsequences.frequent_patterns(e).count() == 0
