"""Most similar vectors for every vector (problem 3) by multi-index hashing.

A rotation learned on a bounded sample turns the vectors; each rotated axis is cut into intervals a
few search radii wide, written as unary bits, so the Hamming distance of two codes is the number of
interval steps between them. The code is split into `parts` substrings of neighbouring axes and each
substring is indexed. Of two codes whose Hamming distance is below twice the number of substrings at
least one pair of substrings differs in one bit at most (pigeonhole), so a code is held under its own
value in each substring and probes the values one bit away whose interval border is nearer than an
eighth of the radius (two codes in 16 axes differ by a quarter of it on an axis, and either may probe).
The interval width follows from the search radius alone, so a value of a substring holds more vectors
where they lie denser. A value with more than `heavy` of them gets second codes of its own: sign bits
around the medians of seeded rotations, in substrings of as many bits as leaves of `leaf` vectors
take, and as many substrings as it takes to keep the share `recall` of the neighbour pairs in a
sample of that value. Neighbours in a sample are farther apart than in the whole, so that share is a
lower bound. Candidates are reranked by their float distances.

Sizes, models and leaves of the values are tables: nothing about them is gathered on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklode.llm import vectors as V
from tracklode.runtime import Scratch

#: Vectors per substring value that are compared directly; beyond it the value is coded again, for
#: leaves of about LEAF vectors.
HEAVY, LEAF = 8_192, 2_048
#: Share of a sample's neighbour pairs that second codes must keep, and the most tables for it.
RECALL, TABLES = 0.98, 64
#: Rows of a heavy value that its second codes are fitted on.
SAMPLE = 4_000


def _partitions(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _hashed(cell: np.ndarray, s: int) -> np.ndarray:
    """64-bit key of interval numbers (rows, axes); its last two bits are the substring's number."""
    h = np.full(len(cell), 0x9E3779B97F4A7C15 * (s + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for c in cell.astype(np.uint64).T:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return ((h & np.uint64(0xFFFFFFFFFFFFFFFC)) | np.uint64(s)).view(np.int64)


def substring_keys(y: np.ndarray, width: float, parts: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, rows, probes): the key of each row and substring, and the keys at Hamming distance one
    whose interval border is nearer than `reach`, with the numbers of their rows."""
    at = y / width
    cell = np.floor(at).astype(np.int64)
    off = (at - cell) * width
    keys, rows, probes = np.zeros((len(y), parts), np.int64), [], []
    for s, axes in enumerate(np.array_split(np.arange(y.shape[1]), parts)):
        keys[:, s] = _hashed(cell[:, axes], s)
        for n, axis in enumerate(axes):
            for step, near in ((-1, off[:, axis] < reach), (1, off[:, axis] > width - reach)):
                r = np.flatnonzero(near)
                c = cell[np.ix_(r, axes)]
                c[:, n] += step
                rows.append(r)
                probes.append(_hashed(c, s))
    return keys, np.concatenate(rows), np.concatenate(probes)


def _keyed(reps: DataFrame, dim: int, mean, turn, width: float, parts: int, reach: float) -> DataFrame:
    """(rep, v, keys, probes): each vector with its key in every substring, and the keys it is held under too."""

    def run(batches):
        for b in batches:
            y = (V.as_matrix(b.column(1), dim) - mean) @ turn
            keys, rows, probes = substring_keys(y, width, parts, reach)
            order = np.argsort(rows, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(y)))]).astype(np.int32)
            own = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), parts).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), own, pa.ListArray.from_arrays(pa.array(ends), pa.array(probes[order]))], names=["rep", "v", "keys", "probes"])

    return reps.select("rep", "v").mapInArrow(run, "rep string, v array<double>, keys array<bigint>, probes array<bigint>")


def _open_values(long: DataFrame, parts: int, heavy: int) -> DataFrame:
    """(key, n): values with at least two vectors whose pairs don't all meet elsewhere already.

    A value whose vectors also share an earlier substring is left out if that one is compared
    directly, or if both are heavy (then the earlier one's second codes keep the same share).
    """
    s = F.pmod("key", F.lit(4))  # see _hashed
    shared = [F.when((F.min(s) > i) & (F.min(F.col("keys")[i]) == F.max(F.col("keys")[i])), F.first(F.col("keys")[i])) for i in range(parts - 1)]
    values = long.groupBy("key").agg(F.count("*").alias("n"), F.array_compact(F.array(*shared)).alias("shared")).where("n > 1")
    return values.withColumn("heavy", F.col("n") > heavy)


def _uncovered(values: DataFrame) -> DataFrame:
    up = values.select(F.col("key").alias("up"), F.col("heavy").alias("up_heavy"))
    asked = values.where(F.size("shared") > 0).select("key", "heavy", F.explode("shared").alias("up"))
    covered = asked.join(up, "up").where("heavy OR NOT up_heavy").select("key").distinct()
    return values.join(covered, "key", "left_anti").select("key", "n", "heavy")


def _turns(dim: int, columns: int, seed: int) -> np.ndarray:
    """Seeded rotations side by side, `columns` axes in all; the same on every machine."""
    r, out = np.random.default_rng(seed), []
    for _ in range(-(-columns // dim)):
        q, up = np.linalg.qr(r.normal(size=(dim, dim)))
        out.append(q * np.where(np.diag(up) < 0, -1.0, 1.0))
    return np.concatenate(out, axis=1)[:, :columns]


def _models(found: DataFrame, dim: int, k: int, limit: float, seed: int, leaf: int, recall: float, sample: int) -> DataFrame:
    """(key, bits, mid): of each heavy value the bits of a substring and the medians of all bits."""

    def fit(key, table):
        x = V.as_matrix(table["v"].combine_chunks(), dim)
        bits = max(1, math.ceil(math.log2(table["n"][0].as_py() / leaf)))
        y = x @ _turns(dim, bits * TABLES, seed)
        mid = np.median(y, axis=0)
        i, j, _ = V.near_pairs(x, x, limit, k, same=True)
        if len(i) < 20:  # too thin a sample to hold neighbours: its nearest pairs, farther apart
            i, j, _ = V.near_pairs(x, x, np.inf, 1, same=True)
        on = (y > mid).reshape(len(x), TABLES, bits)
        kept = np.logical_or.accumulate((on[i] == on[j]).all(2), axis=1).mean(0) if len(i) else np.ones(TABLES)
        tables = int(np.argmax(kept >= recall)) + 1 if (kept >= recall).any() else TABLES
        return pa.table({"key": pa.array([table["key"][0].as_py()], pa.int64()), "bits": pa.array([bits], pa.int32()), "mid": pa.array([mid[: bits * tables].tolist()], pa.list_(pa.float64()))})

    picked = found.where(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1_000_003)) < F.lit(1_000_003 * sample) / F.col("n"))
    return picked.select("key", "v", "n").groupBy("key").applyInArrow(fit, "key bigint, bits int, mid array<double>")


def _recoded(found: DataFrame, models: DataFrame, dim: int, seed: int) -> DataFrame:
    """(key, rep, v): rows of heavy values under the keys of their second codes."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = V.as_matrix(b.column(2), dim)
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for key in np.unique(keys):
                at = np.flatnonzero(keys == key)
                bits, mid = b.column(3)[int(at[0])].as_py(), np.array(b.column(4)[int(at[0])].as_py(), float)
                on = x[at] @ _turns(dim, len(mid), seed) > mid
                p = pa.array(at)
                for j in range(len(mid) // bits):
                    code = on[:, j * bits : (j + 1) * bits] @ (1 << np.arange(bits, dtype=np.int64))
                    h = (np.uint64(np.int64(key).view(np.uint64)) ^ (np.uint64(j + 1) << np.uint64(40)) ^ code.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
                    h ^= h >> np.uint64(31)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(1).take(p), b.column(2).take(p)], names=["key", "rep", "v"])

    return found.join(models, "key").select("key", "rep", "v", "bits", "mid").mapInArrow(run, "key bigint, rep string, v array<double>")


def _rank(dim: int, k: int, limit: float):
    """Complete groups of one key -> (rep, other, dist): of each vector the k nearest in its group."""

    def run(batches):
        for t in V.whole_groups(batches, "key"):
            ends = V.group_bounds(t["key"].to_numpy())
            size = np.diff(ends)
            if not (size > 1).any():
                continue
            x = V.as_matrix(t["v"].combine_chunks(), dim)
            i_all, j_all, d_all = [], [], []
            for a, n in zip(ends[:-1][size > 1], size[size > 1]):
                i, j, d = V.near_pairs(x[a : a + n], x[a : a + n], limit, k, same=True)
                i_all.append(i + a)
                j_all.append(j + a)
                d_all.append(d)
            rep = t["rep"].combine_chunks()
            i, j = np.concatenate(i_all), np.concatenate(j_all)
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(i)), rep.take(pa.array(j)), pa.array(np.concatenate(d_all))], names=["rep", "other", "dist"])

    return run


def nearest(scratch: Scratch, reps: DataFrame, n: int, dim: int, k: int, limit: float, parts: int = 3, width: float | None = None, seed: int = 17, heavy: int = HEAVY, leaf: int = LEAF, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(rep, other, dist): up to k nearest other vectors of each within `limit`, ties by the smaller rid."""
    spark = reps.sparkSession
    mean, turn = V.fit_rotation(reps, n, dim, seed)
    if not 1 <= parts <= 4:
        raise ValueError("between 1 and 4 substrings")
    keyed = scratch.table(_keyed(reps, dim, mean, turn, width or 4 * limit, parts, limit / 8))
    long = keyed.select("rep", "v", "keys", F.explode(F.concat("keys", "probes")).alias("key"))
    values = scratch.table(_open_values(long.drop("v"), parts, heavy))
    todo = scratch.table(_uncovered(values))
    rows = long.select("key", "rep", "v").join(todo.where("NOT heavy").select("key"), "key")
    hot = todo.where("heavy").select("key", "n")
    used = [keyed, values, todo]
    if not hot.isEmpty():
        found = scratch.table(long.select("key", "rep", "v").join(hot, "key"))
        models = scratch.table(_models(found, dim, k, limit, seed, leaf, recall, sample))
        rows = rows.unionByName(_recoded(found, models, dim, seed))
        used += [found, models]
    ranked = rows.repartition(_partitions(spark), "key").sortWithinPartitions("key", "rep").mapInArrow(_rank(dim, k, limit), "rep string, other string, dist double")
    # a pair met in several values has one rank; copies of it go within the partitioning of the window
    w = Window.partitionBy("rep").orderBy("dist", "other")
    near = scratch.table(ranked.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= k).drop("_r").distinct())
    scratch.drop(*used)
    return near


def nearest_records(points: DataFrame, dim: int = 16, k: int = 5, limit: float = 2.5, **index) -> DataFrame:
    """(rid, other, dist): up to k nearest other rids of each rid within `limit`.

    points has rid and features; unusable vectors are left out as in vectors.usable, repeated rids
    count once. Equal vectors under different rids are neighbours at distance 0; equal distances go
    to the smaller rid. Vectors are indexed once per distinct value, so a large group of copies
    costs one index entry and k + 1 names. An empty table gives no rows.
    """
    scratch = Scratch(points.sparkSession, "nearest")
    pts = scratch.table(V.usable(points, dim))
    reps = scratch.table(V.classes(pts))
    n = reps.count()
    near = nearest(scratch, reps, n, dim, k, limit, **index)
    many = reps.where("n > 1").select("v", "rep", "n")
    member = pts.join(many, "v").select("rep", "rid")  # members of groups of copies only
    few = member.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("rid"))).where(F.col("_r") <= k + 1).drop("_r")
    named = few.select(F.col("rep").alias("other"), F.col("rid").alias("name"))
    # the nearest names of each distinct vector, copies of a neighbour included
    seen = near.join(named, "other", "left").select("rep", F.coalesce("name", "other").alias("name"), "dist")
    own = few.select("rep", F.col("rid").alias("name"), F.lit(0.0).alias("dist"))
    w = Window.partitionBy("rep").orderBy("dist", "name")
    lists = seen.unionByName(own).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    single = lists.join(many.select("rep"), "rep", "left_anti").where(F.col("_r") <= k).select(F.col("rep").alias("rid"), F.col("name").alias("other"), "dist")
    packed = lists.join(many.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("dist", "name"))).alias("l"))
    copies = (
        member.join(packed, "rep")
        .select("rid", F.explode(F.slice(F.filter("l", lambda e: e["name"] != F.col("rid")), 1, k)).alias("e"))
        .select("rid", F.col("e.name").alias("other"), F.col("e.dist").alias("dist"))
    )
    return single.unionByName(copies)


def neighbour_pairs(points: DataFrame, **options) -> DataFrame:
    """(rid_a, rid_b), rid_a < rid_b: pairs in which at least one is a neighbour of the other."""
    t = nearest_records(points, **options)
    return t.select(F.least("rid", "other").alias("rid_a"), F.greatest("rid", "other").alias("rid_b")).distinct()


def measured_recall(points: DataFrame, asked: Column, dim: int = 16, k: int = 5, limit: float = 2.5, block: int = 4_000, **index) -> DataFrame:
    """(n_queries, n_true, n_found): neighbours of the records that the condition `asked` (on rid) names,
    by comparing each of them with all records, and how many of those nearest_records finds.

    Queries meet the records in blocks of `block`; a record is sent once per block of queries. An
    empty table gives zeros.
    """
    scratch = Scratch(points.sparkSession, "recall")
    pts = scratch.table(V.usable(points, dim))
    asked = scratch.table(pts.where(asked))
    blocks = max(1, -(-asked.count() // block))
    ask = asked.select(F.pmod(F.xxhash64("rid"), F.lit(blocks)).alias("b"), "rid", "v", F.lit(True).alias("ask"))
    parts = _partitions(points.sparkSession)
    # every part of the records meets every block of queries
    cut = F.pmod(F.xxhash64("rid", F.lit(9)), F.lit(parts))
    held = pts.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).select("b", cut.alias("c"), "rid", "v", F.lit(False).alias("ask"))
    both = held.unionByName(ask.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))).select("b", "c", "rid", "v", "ask"))

    def run(batches):
        for t in V.whole_groups(batches, "key"):
            ends = V.group_bounds(t["key"].to_numpy())
            x, q = V.as_matrix(t["v"].combine_chunks(), dim), t["ask"].to_numpy(zero_copy_only=False).astype(bool)
            rid = t["rid"].combine_chunks()
            for a, z in zip(ends[:-1], ends[1:]):
                p, r = np.flatnonzero(q[a:z]) + a, np.flatnonzero(~q[a:z]) + a
                if len(p) and len(r):
                    i, j, d = V.near_pairs(x[p], x[r], limit, k + 1)
                    yield pa.RecordBatch.from_arrays([rid.take(pa.array(p[i])), rid.take(pa.array(r[j])), pa.array(d)], names=["rid", "other", "dist"])

    rows = both.select(F.xxhash64("b", "c").alias("key"), "rid", "v", "ask").repartition(parts, "key").sortWithinPartitions("key", "rid")
    near = rows.mapInArrow(run, "rid string, other string, dist double").where("rid <> other")
    w = Window.partitionBy("rid").orderBy("dist", "other")
    true = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("rid", "other")
    got = nearest_records(points, dim, k, limit, **index).select("rid", "other", F.lit(1).alias("got"))
    n = true.join(got, ["rid", "other"], "left").agg(F.count("*").alias("n_true"), F.count("got").alias("n_found"))
    return asked.agg(F.count("*").alias("n_queries")).crossJoin(n)
