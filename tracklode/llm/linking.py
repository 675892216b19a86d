"""Consolidating pairwise matches into groups (problem 4) by low-diameter decomposition.

Each level draws for every vertex a start time from an exponential distribution (by hash, so a
recomputed task draws the same), lets clusters grow along the edges one hop per round, contracts
each cluster to one super-vertex and goes on with the edges between clusters only. The maps of all
levels are composed from the smallest to the largest, carrying the smallest rid of each group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklode.runtime import Scratch

#: Contracted edges that one task finishes with a union-find; fixed, so its memory is bounded.
FINISH_EDGES = 50_000


def _finish(batches):
    """Union-find over at most FINISH_EDGES contracted edges: (id, center) of every vertex."""
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["src"], pdf["dst"]):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pd.DataFrame({"id": pd.Series(ids, dtype="str"), "center": pd.Series([root(x) for x in ids], dtype="str")})


def _level(edges: DataFrame, level: int, rate: float, rounds: int) -> DataFrame:
    """(id, center) after one decomposition of the symmetric edge list (src, dst)."""
    # head start of a vertex: exponential, cut at the number of rounds
    u = (F.abs(F.xxhash64(F.col("id"), F.lit(7919 * (level + 1)))) % F.lit(1 << 52) + 1) / F.lit(float((1 << 52) + 1))
    start = F.least(-F.log(u) / F.lit(rate), F.lit(float(rounds)))
    begin = lambda c: F.struct((-start).alias("t"), c.alias("c"))
    # hops of length 0 keep a vertex's own cluster in the running, so each round reads the last one once
    hops = edges.select("src", "dst", F.lit(1.0).alias("hop")).unionByName(edges.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("hop")).distinct())
    first = hops.withColumn("id", F.col("src")).select("dst", "hop", begin(F.col("id")).alias("best"))
    own = None
    for _ in range(rounds):
        # the cluster whose shifted start plus hops is least reaches a vertex first
        sent = first if own is None else hops.join(own, "src").select("dst", "hop", "best")
        own = sent.groupBy(F.col("dst").alias("src")).agg(F.min(F.struct((F.col("best.t") + F.col("hop")).alias("t"), F.col("best.c").alias("c"))).alias("best"))
    return own.select(F.col("src").alias("id"), F.col("best.c").alias("center"))


def group_ids(pairs: DataFrame, a: str = "rid_a", b: str = "rid_b", rate: float = 0.7, rounds: int = 2, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """(rid, group_rid): each distinct non-null rid with the smallest rid linked to it.

    A row with both rids non-null is a match; repeated, reversed and self pairs change nothing. A
    rid whose partners are all null or itself forms its own group. Other columns are ignored; an
    empty table gives no rows. Strings compare character by character.
    """
    spark, scratch = pairs.sparkSession, Scratch(pairs.sparkSession, "groups")
    p = pairs.select(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"))
    links = p.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    edges = scratch.table(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    maps: list[DataFrame] = []
    level = 0
    while (n := edges.count()) > 0:
        if n <= finish_edges:
            maps.append(scratch.table(edges.coalesce(1).mapInPandas(_finish, "id string, center string")))
            break
        step = scratch.table(_level(edges, level, rate, rounds))
        maps.append(step)
        to = step.select(F.col("id").alias("src"), F.col("center").alias("_s"))
        to2 = step.select(F.col("id").alias("dst"), F.col("center").alias("_d"))
        inter = edges.join(to, "src").join(to2, "dst").where("_s <> _d").select(F.col("_s").alias("src"), F.col("_d").alias("dst")).distinct()
        fresh = scratch.table(inter)
        scratch.drop(edges)
        edges, level = fresh, level + 1
    every = p.select(F.col("src").alias("rid")).unionByName(p.select(F.col("dst").alias("rid"))).where("rid is not null").distinct()
    if not maps:
        return every.select("rid", F.col("rid").alias("group_rid"))
    # compose from the top: each map is smaller than the one below it
    whole = maps[-1]
    for lower in reversed(maps[:-1]):
        up = whole.select(F.col("id").alias("center"), F.col("center").alias("_top"))
        whole = lower.join(up, "center", "left").select("id", F.coalesce("_top", "center").alias("center"))
    whole = scratch.table(whole)
    names = whole.groupBy("center").agg(F.min("id").alias("group_rid"))
    named = whole.join(names, "center").select(F.col("id").alias("rid"), "group_rid")
    return every.join(named, "rid", "left").select("rid", F.coalesce("group_rid", "rid").alias("group_rid"))
