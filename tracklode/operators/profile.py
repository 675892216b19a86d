"""Statistics of point tables and the encodings built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklode.runtime import is_finite


def numeric_stats(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, min, max, sum, sum_sq, count, mean, std) of each numeric column in one pass; nulls and
    non-finite values are left out, std is that of the population, an empty column has nulls; no
    column, no rows."""
    if not dims:
        return df.sparkSession.createDataFrame([], "dim string, min double, max double, sum double, sum_sq double, count bigint, mean double, std double")
    ok = {d: F.when(is_finite(F.col(d).cast("double")), F.col(d).cast("double")) for d in dims}
    one = df.agg(*(F.struct(F.lit(d).alias("dim"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.sum(c * c).alias("sum_sq"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(d) for d, c in ok.items()))
    return one.select(F.explode(F.array(*(F.col(d) for d in dims))).alias("s")).select("s.*")


def lexicon(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, word, id, count): the words of each nominal column, ids from 0 in alphabetical order;
    nulls are no words; no column, no rows."""
    if not dims:
        return df.sparkSession.createDataFrame([], "dim string, word string, id int, count bigint")
    words = df.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("word")) for d in dims))).alias("w")).select("w.*").where("word IS NOT NULL").groupBy("dim", "word").count()
    return words.select("dim", "word", (F.row_number().over(Window.partitionBy("dim").orderBy("word")) - 1).alias("id"), "count")


def nominal_combos(df: DataFrame, dims: list[str]) -> DataFrame:
    """(combo, count): comma-joined nominal values; with no nominal column one empty combination."""
    return df.groupBy(F.concat_ws(",", *(F.col(d).cast("string") for d in dims)).alias("combo")).count()


def nominal_summary(words: DataFrame) -> DataFrame:
    """(dim, min_id, max_id, cardinality, mode_id) of a lexicon; ties of the mode go to the smaller id."""
    return words.groupBy("dim").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("cardinality"), F.max_by("id", F.struct("count", -F.col("id"))).alias("mode_id"))


def distinct_trajectories(df: DataFrame, col: str = "d_0") -> DataFrame:
    return df.agg(F.count_distinct(col).alias("n_trajectories"))


def cells_per_dim(stats: DataFrame, sizes: dict[str, float]) -> DataFrame:
    """(dim, n_cells): trunc((max - min) / size) + 1 for each dimension with a cell size."""
    size = F.create_map(*(F.lit(x) for kv in sizes.items() for x in (kv[0], float(kv[1]))))
    return stats.where(F.col("dim").isin(list(sizes))).select("dim", (((F.col("max") - F.col("min")) / F.element_at(size, F.col("dim"))).cast("bigint") + 1).alias("n_cells"))


def _wide(stats: DataFrame, dims: list[str], what: list[str]) -> DataFrame:
    """One row with a column what_dim for each; it is one row, so it may be broadcast."""
    return stats.agg(*(F.max(F.when(F.col("dim") == d, F.col(w))).alias(f"_{w}_{d}") for d in dims for w in what))


def std_bins(df: DataFrame, dims: list[str]) -> DataFrame:
    """Adds bin_<dim> = floor((d - min) / std); null where std is zero or d is null."""
    t = df.crossJoin(F.broadcast(_wide(numeric_stats(df, dims), dims, ["min", "std"])))
    out = [F.floor(F.try_divide(F.col(d).cast("double") - F.col(f"_min_{d}"), F.nullif(f"_std_{d}", F.lit(0.0)))).alias(f"bin_{d}") for d in dims]
    return t.select(*df.columns, *out)


def min_max_scaled(df: DataFrame, dims: list[str]) -> DataFrame:
    """Adds scaled_<dim> in [0, 1]; a constant dimension gives 0."""
    t = df.crossJoin(F.broadcast(_wide(numeric_stats(df, dims), dims, ["min", "max"])))
    out = [F.when(F.col(f"_max_{d}") == F.col(f"_min_{d}"), F.when(F.col(d).isNotNull(), F.lit(0.0))).otherwise((F.col(d) - F.col(f"_min_{d}")) / (F.col(f"_max_{d}") - F.col(f"_min_{d}"))).alias(f"scaled_{d}") for d in dims]
    return t.select(*df.columns, *out)


def descaled(df: DataFrame, dims: list[str], stats: DataFrame) -> DataFrame:
    """scaled_<dim> back to the range in stats, as <dim>."""
    t = df.crossJoin(F.broadcast(_wide(stats, dims, ["min", "max"])))
    keep = [c for c in df.columns if c not in dims]
    return t.select(*keep, *((F.col(f"scaled_{d}") * (F.col(f"_max_{d}") - F.col(f"_min_{d}")) + F.col(f"_min_{d}")).alias(d) for d in dims))


def with_rid(df: DataFrame, traj: str = "d_0", tick: str = "d_1") -> DataFrame:
    """Adds rid = "traj,tick"; null where either is null."""
    return df.withColumn("rid", F.when(F.col(traj).isNotNull() & F.col(tick).isNotNull(), F.concat_ws(",", traj, tick)))


def lexicon_ids(df: DataFrame, dims: list[str], words: DataFrame | None = None) -> DataFrame:
    """Adds id_<dim>: the lexicon id of each nominal value, null for null or unseen words."""
    words = lexicon(df, dims) if words is None and dims else words
    out = df
    for d in dims:
        w = words.where(F.col("dim") == d).select(F.col("word").alias(f"_word_{d}"), F.col("id").alias(f"id_{d}"))
        out = out.join(w, out[d].cast("string") == w[f"_word_{d}"], "left").drop(f"_word_{d}")
    return out


def dense_features(df: DataFrame, numeric: list[str], nominal: list[str]) -> DataFrame:
    """Adds features array<double>: the numeric values, then the lexicon ids."""
    t = lexicon_ids(df, nominal)
    feats = F.array(*(F.col(d).cast("double") for d in numeric), *(F.col(f"id_{d}").cast("double") for d in nominal))
    return t.select(*df.columns, feats.alias("features"))


def active_indexes(df: DataFrame, numeric: list[str], nominal: list[str]) -> DataFrame:
    """Adds active array<int>: the set positions of the one-hot vector of std bins and nominal ids
    (no value is dropped), one per non-null dimension, each dimension after those before it."""
    t = lexicon_ids(std_bins(df, numeric) if numeric else df, nominal)
    cols = [f"bin_{d}" for d in numeric] + [f"id_{d}" for d in nominal]
    widths = t.agg(*(F.coalesce(F.max(c) + 1, F.lit(0)).cast("bigint").alias(f"_w_{c}") for c in cols))
    before = F.lit(0).cast("bigint")
    parts = []
    for c in cols:
        parts.append(F.col(c).cast("bigint") + before)
        before = before + F.col(f"_w_{c}")
    return t.crossJoin(F.broadcast(widths)).select(*df.columns, F.filter(F.array(*parts), lambda x: x.isNotNull()).cast("array<int>").alias("active"))


def mixed_centroid(df: DataFrame, group: str, numeric: list[str], nominal: list[str]) -> DataFrame:
    """(group, <numeric means>, <nominal modes>) per group; ties of a mode go to the smaller word."""
    out = df.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(d).alias(d) for d in numeric))
    for d in nominal:
        c = df.where(F.col(d).isNotNull()).groupBy(group, d).count()
        top = c.groupBy(group).agg(F.min(F.struct(-F.col("count"), F.col(d).alias("w"))).alias("_m")).select(group, F.col("_m.w").alias(d))
        out = out.join(top, group, "left")
    return out


def pairwise_cost(df: DataFrame, group: str, numeric: list[str]) -> DataFrame:
    """(group, n, cost): the sum of the squared Euclidean distances of all pairs of a group's rows over the
    numeric columns. It is n² times the sum of their variances, so no pair is formed.
    Rows with a value that isn't finite are left out."""
    ok = F.lit(True)
    for d in numeric:
        ok = ok & is_finite(F.col(d).cast("double"))
    t = df.where(ok).select(group, *(F.col(d).cast("double").alias(d) for d in numeric))
    cost = sum((F.count("*") * F.count("*") * F.var_pop(d) for d in numeric), F.lit(0.0))
    return t.groupBy(group).agg(F.count("*").alias("n"), cost.alias("cost"))


def histogram(df: DataFrame, col: str, buckets: int = 16, weight: str | None = None) -> DataFrame:
    """(lo, hi, count): equal-width buckets over the range of col; the last one includes the maximum,
    empty buckets count 0, a single value gives one bucket. Nulls are left out; no values, no rows.
    weight: the column with the number of rows each value stands for."""
    v = df.select(F.col(col).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w")).where(is_finite(F.col("_v")))
    span = v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_lo IS NOT NULL")
    width = (F.col("_hi") - F.col("_lo")) / buckets
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(buckets - 1))).cast("int")
    counts = v.crossJoin(F.broadcast(span)).groupBy(at.alias("_b")).agg(F.sum("_w").alias("count"))
    every = span.select("_lo", "_hi", F.explode(F.when(F.col("_hi") == F.col("_lo"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(buckets - 1)))).alias("_b"))
    return every.join(F.broadcast(counts), "_b", "left").select((F.col("_lo") + F.col("_b") * width).alias("lo"), F.when((F.col("_b") == buckets - 1) | (F.col("_hi") == F.col("_lo")), F.col("_hi")).otherwise(F.col("_lo") + (F.col("_b") + 1) * width).alias("hi"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
