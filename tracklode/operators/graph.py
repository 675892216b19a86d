"""Connected components and directed reachability on tables of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklode.runtime import Scratch

#: Links that one task finishes in memory once a graph is (or has become) that small.
SMALL = 50_000


def _union_find(kind: pa.DataType):
    """At most SMALL links (u, v): (u, v) with v the smallest id of u's component."""

    def run(batches):
        parent: dict = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        key = lambda x: tuple(x) if isinstance(x, list) else x
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = root(key(x)), root(key(y))
                if x != y:
                    parent[max(x, y)] = min(x, y)
        ids = list(parent)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([root(x) for x in ids], kind)], names=["u", "v"])

    return run


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id of a link with the smallest id of its component.

    Alternates two contractions until nothing changes: each vertex links its larger neighbours to the
    smallest one (large star), then itself and its smaller ones to it (small star). Rounds grow with
    the logarithm of the longest path; a graph of few links is finished in one task. Links with a null end are ignored; self links keep their id.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    every = scratch.table(e.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    links = scratch.table(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    kind = links.select("u").limit(0).toArrow().schema.field(0).type
    while True:
        if not pa.types.is_struct(kind) and links.count() <= SMALL:
            links = scratch.table(links.coalesce(1).mapInArrow(_union_find(kind), links.schema))
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every vertex also keeps its link to the smallest one it knows
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        fresh = scratch.table(small.distinct())
        now = tuple(fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        scratch.drop(links)
        links = fresh
        if now == mark:
            break
        mark = now
    return every.join(links.groupBy("u").agg(F.min("v").alias("_m")).withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("_m", "id").alias("component"))


def union_of_sets(members: DataFrame, set_col: str, item_col: str) -> DataFrame:
    """(item, component): items whose sets overlap, directly or through other sets, under their
    smallest item. Each set becomes a star around its smallest item, so large sets cost one link a
    member."""
    m = members.select(F.col(set_col).alias("_s"), F.col(item_col).alias("_i")).dropna()
    first = m.groupBy("_s").agg(F.min("_i").alias("_f"))
    return connected_components(m.join(first, "_s").select(F.col("_i").alias("a"), F.col("_f").alias("b")).distinct()).withColumnRenamed("id", "item")


def least_ancestor(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, label): of each vertex the least (rank, v) among the vertices that reach it along directed
    links (u, v), itself included. vertices: v, rank."""
    scratch = Scratch(edges.sparkSession, "ancestors")
    links = scratch.table(edges.select("u", "v").where("u <> v").distinct())
    label = scratch.table(vertices.select("v", F.struct("rank", "v").alias("label")))
    moved = label
    while True:
        sent = links.join(moved.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("got"))
        fresh = scratch.table(label.join(sent, "v", "left").select("v", F.least("label", F.coalesce("got", "label")).alias("label"), (F.coalesce("got", "label") < F.col("label")).alias("changed")))
        moved = fresh.where("changed").select("v", "label")
        label = fresh.select("v", "label")
        if moved.isEmpty():
            return label


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, v): every vertex that each seed reaches along directed links (u, v), itself included."""
    scratch = Scratch(edges.sparkSession, "reach")
    links = scratch.table(edges.select("u", "v").where("u <> v").distinct())
    found = scratch.table(seeds.select("seed", F.col("seed").alias("v")))
    front = found
    while not front.isEmpty():
        step = front.join(links.withColumnRenamed("v", "w").withColumnRenamed("u", "v"), "v").select("seed", F.col("w").alias("v")).distinct()
        front = scratch.table(step.join(found, ["seed", "v"], "left_anti"))
        found = scratch.table(found.unionByName(front))
    return found
