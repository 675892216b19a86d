"""Frequent ordered patterns of areas with gaps (problem 2) by last-position induction.

Usable items become compact sequences, one per trajectory; a trajectory with very many items is cut
into overlapping time windows, so no task ever holds more than a window of it. Patterns grow level
by level. For each sequence and item the last position is computed once; an item can extend a
prefix in a sequence only if its last position exceeds the end of the prefix's first occurrence, so
sequences that fail this test are dropped before any occurrence is looked at. For those that pass,
the occurrences of the item are kept that lie within the allowed gap after some end of the prefix.
A pattern counts once per trajectory; only counts (and, for cut trajectories, their ids) are moved.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklode.llm.vectors import group_bounds
from tracklode.runtime import Scratch

#: Distinct items of one trajectory beyond which it is cut into windows.
LONG = 5_000
#: Items a worker looks at together.
CHUNK_ITEMS = 1_000_000


def usable_items(rows: DataFrame) -> DataFrame:
    """(d_0, time, area_id) once each: d_0 non-null, item non-null, time >= 0, area_id > 0."""
    item = rows.where(F.col("d_0").isNotNull()).select(F.col("d_0").cast("bigint").alias("d_0"), F.explode("items").alias("i"))
    t = item.select("d_0", F.col("i.time").cast("bigint").alias("time"), F.col("i.area_id").cast("int").alias("area_id"))
    return t.where("time >= 0 AND area_id > 0").distinct()


def sequences(items: DataFrame, max_gap: int, steps: int, long: int = LONG) -> DataFrame:
    """(d_0, win, whole, until, items sorted by time): a whole trajectory, or windows of a long one.

    A window of a long trajectory holds the items from its start up to `steps` gaps beyond its end;
    patterns with at most `steps` gaps that start in the window (before `until`) lie inside it.
    """
    # counted per batch on the map side, so a long trajectory moves as counts
    counts = items.groupBy("d_0").agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > long).select("d_0", F.lit(True).alias("_hot"))
    t = items.join(hot, "d_0", "left")
    reach = max_gap * steps
    span = 4 * reach
    w = F.floor(F.col("time") / span)
    first = F.floor(F.greatest(F.col("time") - reach, F.lit(0)) / span)
    keyed = t.select("d_0", F.explode(F.when(F.col("_hot"), F.sequence(first, w)).otherwise(F.array(F.lit(-1).cast("bigint")))).alias("win"), "time", "area_id")
    packed = keyed.groupBy("d_0", "win").agg(F.sort_array(F.collect_list(F.struct("time", "area_id"))).alias("i"))
    return packed.select("d_0", "win", (F.col("win") < 0).alias("whole"), F.when(F.col("win") >= 0, (F.col("win") + 1) * span).alias("until"), F.col("i.time").alias("times"), F.col("i.area_id").alias("areas"))


class _Block:
    """Sequences of some rows in flat arrays; times are shifted so that sequences never come near."""

    def __init__(self, table: pa.Table, max_gap: int):
        self.gap = max_gap
        times = table["times"].combine_chunks()
        n = np.diff(times.offsets.to_numpy())
        self.ids = table["d_0"].to_numpy()
        whole = table["whole"].to_numpy(zero_copy_only=False)
        self.whole = whole.astype(bool)
        t = times.flatten().to_numpy().astype(np.int64)
        area = table["areas"].combine_chunks().flatten().to_numpy()
        seq = np.repeat(np.arange(len(n)), n)
        lo = np.minimum.reduceat(t, np.concatenate([[0], np.cumsum(n)[:-1]])) if len(t) else t
        hi = np.maximum.reduceat(t, np.concatenate([[0], np.cumsum(n)[:-1]])) if len(t) else t
        shift = np.concatenate([[0], np.cumsum(hi - lo + max_gap + 1)[:-1]]) - lo if len(t) else t
        until = table["until"].to_numpy(zero_copy_only=False).astype(float)
        self.starts_ok = ~(t >= np.where(np.isnan(until), np.inf, until)[seq])  # first items count in their own window only
        self.t = t + shift[seq]
        self.seq = seq
        order = np.lexsort((self.t, area))
        self.area, self.order = area[order], order
        ends = group_bounds(self.area)
        self.at = {int(self.area[a]): order[a:z] for a, z in zip(ends[:-1], ends[1:])} if len(area) else {}
        self.lasts, self.n = {}, len(n)

    def last(self, item: int) -> np.ndarray:
        """Last position of the item in each sequence, -1 where it doesn't occur."""
        if item not in self.lasts:
            out = np.full(self.n, -1, np.int64)
            out[self.seq[self.at[item]]] = self.t[self.at[item]]  # rows are in time order
            self.lasts[item] = out
        return self.lasts[item]

    def first(self, item: int) -> np.ndarray:
        rows = self.at.get(item, np.zeros(0, int))
        return rows[self.starts_ok[rows]]

    def extend(self, ends: np.ndarray, item: int) -> np.ndarray:
        """Rows of `item` that follow some prefix end (rows) within the gap."""
        if not len(ends) or item not in self.at:
            return ends[:0]
        s = self.seq[ends]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        passing = s[head][self.last(item)[s[head]] > self.t[ends[head]]]  # the induction test
        if not len(passing):
            return ends[:0]
        rows = self.at[item]
        keep = np.zeros(self.n, bool)
        keep[passing] = True
        rows = rows[keep[self.seq[rows]]]
        et = self.t[ends]
        before = np.searchsorted(et, self.t[rows]) - 1  # the last end strictly before
        ok = before >= 0
        ok[ok] = self.t[rows[ok]] - et[before[ok]] <= self.gap
        return rows[ok]


def _count(max_gap: int, prefixes: list[tuple], grow: dict):
    """Partial supports of the candidates prefix + item: (pattern, traj or null, n)."""

    def chunks(batches):
        got, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 1_000):  # rows hold at most a window of items
                got.append(b.slice(at, 1_000))
                size += len(got[-1].column(3).flatten())
                if size > CHUNK_ITEMS:
                    yield pa.Table.from_batches(got)
                    got, size = [], 0
        if size:
            yield pa.Table.from_batches(got)

    def run(batches):
        for table in chunks(batches):
            yield count(table)

    def count(table):
        block = _Block(table, max_gap)
        out_p, out_t, out_n = [], [], []

        def put(pattern, rows):
            s = np.unique(block.seq[rows])
            if not len(s):
                return
            name = ",".join(map(str, pattern))
            n = int(block.whole[s].sum())
            if n:
                out_p.append(name), out_t.append(None), out_n.append(n)
            for d in np.unique(block.ids[s[~block.whole[s]]]):
                out_p.append(name), out_t.append(int(d)), out_n.append(1)

        if not prefixes:
            for item in block.at:
                put((item,), block.at[item])
        path: list[np.ndarray] = []
        now: tuple = ()
        for prefix in prefixes:  # in order, so what neighbours share is computed once
            common = 0
            while common < min(len(now), len(prefix)) and now[common] == prefix[common]:
                common += 1
            path = path[:common]
            for i in range(common, len(prefix)):
                path.append(block.first(prefix[0]) if i == 0 else block.extend(path[-1], prefix[i]))
            now = prefix
            for item in grow[prefix]:
                put((*prefix, item), block.extend(path[-1], item))
        return pa.RecordBatch.from_arrays([pa.array(out_p, pa.string()), pa.array(out_t, pa.int64()), pa.array(out_n, pa.int64())], names=["pattern", "traj", "n"])

    return run


def frequent_patterns(rows: DataFrame, min_share: float = 0.08, max_gap: int = 800, least: int = 2, long: int = LONG, window_steps: int = 8) -> DataFrame:
    """(pattern, support): ordered area patterns of at least `least` areas that at least
    `min_share` of all distinct non-null d_0 of the table support.

    A trajectory supports ⟨a1,…,ak⟩ if it has usable items with these areas in this order whose times
    rise at each step by more than 0 and at most `max_gap`; all rows of one d_0 form one sequence,
    equal (time, area_id) count once, the same area may occur again in a pattern. Null d_0, null,
    unset and empty items are left out (a d_0 without usable items still counts in the total). An
    empty table gives no rows. pattern: the area ids joined with commas.

    Only frequent patterns and their candidate extensions reach the driver: by the share asked for,
    their number doesn't grow with the rows.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "patterns")
    total = rows.select("d_0").where(F.col("d_0").isNotNull()).distinct().count()
    need = max(1, math.ceil(min_share * total - 1e-9))
    items = scratch.table(usable_items(rows))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def build(steps):
        return scratch.table(sequences(items, max_gap, steps, long).repartition(parts, "d_0", "win"))

    def supports(seqs, prefixes, grow):
        part = seqs.select("d_0", "whole", "until", "times", "areas").mapInArrow(_count(max_gap, prefixes, grow), "pattern string, traj bigint, n bigint")
        # windows of one trajectory count once
        once = part.groupBy("pattern", "traj").agg(F.sum("n").alias("n")).select("pattern", F.when(F.col("traj").isNull(), F.col("n")).otherwise(1).alias("n"))
        kept = once.groupBy("pattern").agg(F.sum("n").alias("support")).where(F.col("support") >= need)
        return {tuple(map(int, r[0].split(","))): r[1] for r in kept.collect()}

    steps = window_steps
    seqs = build(steps)
    found: dict = {}
    level = supports(seqs, [], {})
    singles = sorted(p[0] for p in level)
    while level:
        found |= level
        # the end of a frequent pattern, without its first step, must be frequent too
        ends: dict = {}
        for p in level:
            ends.setdefault(p[:-1], []).append(p[-1])
        grow = {p: sorted(ends.get(p[1:], [])) if len(p) > 1 else singles for p in sorted(level)}
        grow = {p: g for p, g in grow.items() if g}
        if not grow:
            break
        k = len(next(iter(grow)))
        if k > steps:
            steps *= 2
            scratch.drop(seqs)
            seqs = build(steps)
        level = supports(seqs, list(grow), grow)
    out = [(",".join(map(str, p)), int(n)) for p, n in found.items() if len(p) >= least]
    return spark.createDataFrame(out, "pattern string, support bigint")
