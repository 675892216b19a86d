"""All similar pairs between set-valued records (problem 6) by pigeonhole partitioning, exactly.

For sizes a <= b and a Jaccard similarity of at least `threshold` two sets differ in at most
H = a + b - 2 * ceil(threshold / (1 + threshold) * (a + b)) tokens. Set sizes fall into bands; each
band splits the token universe into segments of its own, one for the very common tokens and the
others by hash. Spend H + 1 units on segments of the smaller set, one for asking that a segment is
equal, two for asking that it is equal up to one token: if all these questions fail the sets differ
in more than H tokens, so every similar pair agrees in at least one. The larger set is indexed under
its segments and their one-deletion variants, the smaller one chooses the segments that promise the
fewest candidates. Where a set hasn't enough non-empty segments for H + 1 units (well below one in a
hundred) its rarest tokens, a prefix that any similar set must share, are asked instead, which is
exact too. Candidates that agree are cut down by their sizes and by 128 parity bits, whose number of
differences never exceeds that of the sets, and then verified on the sets. Sets held under a
signature that very many share are split by hash, and each part is asked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklode.runtime import Scratch, spread

#: Share of records from which a token counts as common, and from which its frequency is known.
COMMON, KNOWN = 0.002, 0.0005
#: Segments of a band per token of its largest set.
SEGMENTS = 0.7
#: Sets whose signatures are counted to find frequent ones, the share of their entries from which a
#: signature counts as frequent, and the parts its sets are split into.
SAMPLE, FREQUENT, SALTS = 20_000, 0.0005, 16


def least_overlap(threshold: float, both: int) -> int:
    return math.ceil(threshold / (1 + threshold) * both - 1e-9)


def band_of(size: int) -> tuple[int, int]:
    """Least and largest size of the band: they grow by about 15 %."""
    lo = 1
    while True:
        hi = max(lo, math.floor(lo * 1.15))
        if size <= hi:
            return lo, hi
        lo = hi + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signatures:
    """The signatures of many sets at once. A segment is named by the sum of its tokens' hashes, so
    leaving a token out is one subtraction; a chance collision only adds a candidate to verify."""

    def __init__(self, threshold: float, shares: dict[int, float]):
        self.threshold = threshold
        self.known = np.array(sorted(shares), np.int64)
        self.share = np.array([shares[t] for t in self.known.tolist()], float)
        self.bands: dict[int, list[tuple[int, int, int, int]]] = {}

    def shares_of(self, tokens: np.ndarray, unseen: float) -> np.ndarray:
        if not len(self.known):
            return np.full(len(tokens), unseen)
        at = np.minimum(np.searchsorted(self.known, tokens), len(self.known) - 1)
        return np.where(self.known[at] == tokens, self.share[at], unseen)

    def asked(self, a: int) -> list[tuple[int, int, int, int]]:
        """(band, segments, units, least overlap) for each band that a set of size a asks."""
        if a not in self.bands:
            out, size, top = [], a, math.floor(a / self.threshold + 1e-9)
            while size <= top:
                lo, hi = band_of(size)
                sizes = range(size, min(hi, top) + 1)
                size = hi + 1
                overlap = [least_overlap(self.threshold, a + b) for b in sizes]
                out.append((lo, math.ceil(SEGMENTS * hi), 1 + max(a + b - 2 * o for b, o in zip(sizes, overlap)), min(overlap)))
            self.bands[a] = out
        return self.bands[a]

    @staticmethod
    def name(lo, kind, k, content) -> np.ndarray:
        tag = (np.asarray(lo, np.uint64) << np.uint64(34)) ^ (np.asarray(k, np.uint64) << np.uint64(2)) ^ np.asarray(kind, np.uint64)
        return (_mix(tag) ^ _mix(content)).view(np.int64)

    def _rarest(self, row: np.ndarray, tokens: np.ndarray, lo: np.ndarray, most: np.ndarray):
        """(row, signature) of the most[row] rarest tokens of each row."""
        order = np.lexsort((tokens, self.shares_of(tokens, 0.0), row))
        r = row[order]
        ok = np.arange(len(r)) - np.searchsorted(r, r) < most[r]
        return r[ok], self.name(lo[r[ok]], 2, 0, tokens[order][ok])

    def _segments(self, row, tokens, lo, m):
        """Tokens in order of (row, segment), the starts of the segments, and their sums."""
        k = 1 + ((tokens * 2654435761) & 0xFFFFFFFF) % m[row]
        k[self.shares_of(tokens, 0.0) > COMMON] = 0
        order = np.lexsort((k, row))
        row, tokens, k = row[order], tokens[order], k[order]
        head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (k[1:] != k[:-1])]))
        return row, tokens, k, head, np.add.reduceat(_mix(tokens), head)

    def indexed_many(self, row: np.ndarray, tokens: np.ndarray, n: int):
        """(row, signature) of the sets' tokens under which they are held. row: 0 … n - 1, ascending."""
        size = np.bincount(row, minlength=n)
        band = {a: band_of(a) for a in np.unique(size).tolist() if a}
        lo = np.array([band[a][0] if a else 0 for a in size.tolist()], np.int64)
        m = np.array([math.ceil(SEGMENTS * band[a][1]) if a else 1 for a in size.tolist()], np.int64)
        r0, s0 = self._rarest(row, tokens, lo, size - np.ceil(self.threshold * size - 1e-9).astype(np.int64) + 1)
        row, tokens, k, head, sums = self._segments(row, tokens, lo, m)
        whole = np.repeat(sums, np.diff(np.append(head, len(row))))
        one = k > 0
        return np.concatenate([r0, row[head], row[one]]), np.concatenate([s0, self.name(lo[row[head]], 0, k[head], sums), self.name(lo[row[one]], 1, k[one], (whole - _mix(tokens))[one])])

    def probes_many(self, row: np.ndarray, tokens: np.ndarray, n: int):
        """(row, signature) that the sets ask for."""
        size = np.bincount(row, minlength=n)
        start = np.concatenate([[0], np.cumsum(size)])
        # one line for each set and band
        of, plan = [], []
        for i, a in enumerate(size.tolist()):
            for b in self.asked(a) if a else ():
                of.append(i)
                plan.append(b)
        if not of:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of, (lo, m, units, overlap) = np.array(of), np.array(plan, np.int64).T
        n_of = size[of]
        line = np.repeat(np.arange(len(of)), n_of)
        tok = tokens[np.repeat(start[of], n_of) + np.arange(len(line)) - np.repeat(np.cumsum(n_of) - n_of, n_of)]
        row, t, k, head, sums = self._segments(line, tok, lo, m)
        width = np.diff(np.append(head, len(row)))
        p = self.shares_of(t, KNOWN)
        equal = np.multiply.reduceat(p, head)
        near = np.maximum(equal, np.add.reduceat(np.repeat(equal, width) / p, head)) * 1.0001
        seg_line, seg_k = row[head], k[head]
        two = np.flatnonzero((seg_k > 0) & (width > 1))
        seg = np.concatenate([np.arange(len(head)), two])
        step = np.concatenate([np.zeros(len(head), np.int64), np.ones(len(two), np.int64)])
        cost = np.concatenate([equal, near[two]])
        order = np.lexsort((step, seg_k[seg], cost, seg_line[seg]))
        seg, step = seg[order], step[order]
        ln = seg_line[seg]
        options = np.bincount(ln, minlength=len(of))
        short = options < units
        ok = (np.arange(len(ln)) - np.searchsorted(ln, ln) < units[ln]) & ~short[ln]
        seg, step = seg[ok], step[ok]
        name = lambda g, kind, content: self.name(lo[seg_line[g]], kind, seg_k[g], content)
        full, part = seg[step == 0], seg[step == 1]
        # equal up to one token: one more there, or one more here
        n_part = width[part]
        inside = np.repeat(head[part], n_part) + np.arange(n_part.sum()) - np.repeat(np.cumsum(n_part) - n_part, n_part)
        wide = np.repeat(part, n_part)
        lines = [seg_line[full], seg_line[part], seg_line[wide]]
        sigs = [name(full, 0, sums[full]), name(part, 1, sums[part]), name(wide, 0, sums[wide] - _mix(t[inside]))]
        if short.any():
            few = short[line]
            r, g = self._rarest(line[few], tok[few], lo, n_of - overlap + 1)
            lines.append(r)
            sigs.append(g)
        return of[np.concatenate(lines)], np.concatenate(sigs)


    def indexed(self, s) -> list[int]:
        """Those of one set under which it is held."""
        return self.indexed_many(np.zeros(len(s), np.int64), np.array(s, np.int64), 1)[1].tolist()

    def probes(self, s) -> list[int]:
        """Those one set asks for."""
        return self.probes_many(np.zeros(len(s), np.int64), np.array(s, np.int64), 1)[1].tolist()


def parity_bits(row: np.ndarray, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each set, as two integers."""
    bit = ((tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) & np.uint64(127)
    out = []
    for half in (0, 1):
        here = (bit >> np.uint64(6)) == half
        word = np.zeros(n, np.uint64)
        np.bitwise_xor.at(word, row[here], np.uint64(1) << (bit[here] & np.uint64(63)))
        out.append(word.view(np.int64))
    return out[0], out[1]


def _emit(threshold: float, shares: dict[int, float], probe: bool):
    def run(batches):
        make = Signatures(threshold, shares)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                ids, sets = batch.column(0).slice(at, 2_000), batch.column(1).slice(at, 2_000)
                n = len(ids)
                size = np.diff(sets.offsets.to_numpy())
                row, tokens = np.repeat(np.arange(n), size), sets.flatten().to_numpy(zero_copy_only=False)
                if not len(row):
                    continue
                b1, b2 = parity_bits(row, tokens, n)
                r, sig = make.probes_many(row, tokens, n) if probe else make.indexed_many(row, tokens, n)
                # a signature once a set
                order = np.lexsort((sig, r))
                r, sig = r[order], sig[order]
                once = np.concatenate([[True], (r[1:] != r[:-1]) | (sig[1:] != sig[:-1])]) if len(r) else np.zeros(0, bool)
                r, sig = r[once], sig[once]
                yield pa.RecordBatch.from_arrays([pa.array(sig), ids.take(pa.array(r)), pa.array(size[r].astype(np.int32)), pa.array(b1[r]), pa.array(b2[r])], names=["sig", "id", "size", "b1", "b2"])

    return run


def clean_sets(df: DataFrame, id_col: str = "rid", set_col: str = "features") -> DataFrame:
    """(rid, s): sorted distinct non-null elements; null rids and sets without elements are left out,
    a rid that comes with several sets keeps the least one."""
    s = F.array_sort(F.array_distinct(F.filter(F.col(set_col).cast("array<bigint>"), lambda x: x.isNotNull())))
    return df.select(F.col(id_col).cast("string").alias("rid"), s.alias("s")).where(F.col("rid").isNotNull() & (F.size("s") > 0)).groupBy("rid").agg(F.min("s").alias("s"))


def similar_classes(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, similarity) ids of different sets in classes (id, s) with at least that similarity."""
    tokens = classes.select(F.explode("s").alias("t")).groupBy("t").count().where(F.col("count") > KNOWN * n)
    shares = {r[0]: r[1] / n for r in tokens.collect()}  # at most mean set size / KNOWN entries
    schema = "sig bigint, id bigint, size int, b1 bigint, b2 bigint"
    base = spread(classes.select("id", "s"))
    probe = base.mapInArrow(_emit(threshold, shares, True), schema).select("sig", *(F.col(c).alias("a_" + c) for c in ("id", "size", "b1", "b2")))
    index = base.mapInArrow(_emit(threshold, shares, False), schema).select("sig", *(F.col(c).alias("b_" + c) for c in ("id", "size", "b1", "b2")))
    # signatures with more than a share FREQUENT of the tokens of a sample; a token makes three entries
    # at most, so there are at most 3 / FREQUENT of them
    drawn = base.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, SAMPLE / max(1, n)))))
    counts = drawn.mapInArrow(_emit(threshold, shares, False), schema).groupBy("sig").count().where(F.col("count") > 1)
    entries = drawn.agg(F.sum(F.size("s")).alias("tokens")).head()[0] or 0
    hot = [r[0] for r in counts.where(F.col("count") > max(16, FREQUENT * entries)).select("sig").collect()]
    keys = ["sig"]
    if hot:
        split = index.sparkSession.createDataFrame([(h,) for h in hot], "sig bigint").withColumn("_hot", F.lit(True))
        one = F.when(F.col("_hot"), F.pmod(F.xxhash64("b_id"), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))
        every = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
        index = index.join(F.broadcast(split), "sig", "left").withColumn("salt", one).drop("_hot")
        probe = probe.join(F.broadcast(split), "sig", "left").withColumn("salt", F.explode(every)).drop("_hot")
        keys = ["sig", "salt"]
    both = F.col("a_size") + F.col("b_size")
    differ = F.bit_count(F.col("a_b1").bitwiseXOR(F.col("b_b1"))) + F.bit_count(F.col("a_b2").bitwiseXOR(F.col("b_b2")))
    once = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_id") < F.col("b_id")))
    fits = once & (F.col("a_size") >= F.col("b_size") * threshold - 1e-9) & (differ <= both - 2 * F.ceil(both * (threshold / (1 + threshold)) - 1e-9))
    candidates = probe.join(index, keys).where(fits).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    sa, sb = classes.select(F.col("id").alias("a"), F.col("s").alias("sa")), classes.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    alike = common / (F.size("sa") + F.size("sb") - common)
    return candidates.join(sa, "a").join(sb, "b").select("a", "b", alike.alias("similarity")).where(F.col("similarity") >= threshold)


def _classes(scratch: Scratch, left: DataFrame, right: DataFrame | None):
    rows = clean_sets(left).withColumn("side", F.lit(0))
    if right is not None:
        rows = rows.unionByName(clean_sets(right).withColumn("side", F.lit(1)))
    rows = scratch.table(rows)
    sets = scratch.table(rows.select("s").distinct().withColumn("id", F.monotonically_increasing_id()))
    return sets, scratch.table(rows.join(sets, "s").select("id", "rid", "side"))


def similar_pairs(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.6) -> DataFrame:
    """(rid_a, rid_b), rid_a < rid_b: all pairs of different rids within `left`, and between `left`
    and `right`, whose sets have a Jaccard similarity of at least `threshold`.

    Columns rid and features of each table; elements that are null or repeated count as absent or
    once, records without an element are left out, distinct rids count once. Equal sets are compared
    once and their records then written out in full. Empty tables give no rows.
    """
    scratch = Scratch(left.sparkSession, "setjoin")
    sets, member = _classes(scratch, left, right)
    links = similar_classes(sets, sets.count(), threshold)
    ma, mb = (member.select(F.col("id").alias(c), F.col("rid").alias("r" + c), F.col("side").alias("s" + c)) for c in "ab")
    apart = links.select("a", "b").join(ma, "a").join(mb, "b").where("sa = 0 OR sb = 0").select("ra", "rb")
    alike = ma.join(mb, ma["a"] == mb["b"]).where("ra < rb AND (sa = 0 OR sb = 0)").select("ra", "rb")
    return apart.unionByName(alike).where("ra <> rb").select(F.least("ra", "rb").alias("rid_a"), F.greatest("ra", "rb").alias("rid_b")).distinct()


def similarity_links(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.6) -> DataFrame:
    """(rid, class_rid, n_class, n_links): one row per record with an element, its group of equal
    sets under the smallest rid, the size of that group and the number of other sets that are
    similar to it. Linear in the records however large a group of copies is."""
    scratch = Scratch(left.sparkSession, "setlinks")
    sets, member = _classes(scratch, left, right)
    links = similar_classes(sets, sets.count(), threshold)
    per = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    group = member.groupBy("id").agg(F.min("rid").alias("class_rid"), F.count("*").alias("n_class"))
    return member.join(group.join(per, "id", "left"), "id").select("rid", "class_rid", "n_class", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
