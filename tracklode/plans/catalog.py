"""Queries of the core operators over the driver's tables, each with the SQL it must agree with.

Every query reads its tables whole. Doubles are rounded to six places where engines may differ.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklode.functions import arrays as A
from tracklode.operators import areas, density, grid, hotspot, kmeans, lsh, meanshift, pairs, profile, sequences, skew
from tracklode.operators import dbscan as db
from tracklode.operators.graph import connected_components
from tracklode.plans import pipeline
from tracklode.runtime import read
from tracklode.sources import io

QUERIES: dict = {}
SQL: dict = {}

DAY_US = 86_400_000_000
HALF_DAY_US = DAY_US // 2
AB = lsh.coefficients(3, 7)


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def micros(c: str = "ts"):
    """Microseconds of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def events(spark, sf_dir):
    """events with t in microseconds and k out of props."""
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros().alias("t"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


# ---- skewed keys (problem 5) ----


@query(
    "p5_found",
    """WITH d AS (SELECT DISTINCT rid, entry, hashValue FROM hash_entries WHERE rid IS NOT NULL AND entry IS NOT NULL AND hashValue IS NOT NULL)
    SELECT entry, hashValue FROM d GROUP BY entry, hashValue HAVING count(*) >= 0.01 * (SELECT count(*) FROM d)""",
)
def p5_found(spark, sf_dir):
    return skew.heavy_keys(read(spark, sf_dir, "hash_entries"))


@query(
    "p5_bucket_counts",
    """SELECT entry, hashValue, count(*) AS n_rows, count(DISTINCT rid) AS n_rids FROM hash_entries
    WHERE rid IS NOT NULL AND entry IS NOT NULL AND hashValue IS NOT NULL GROUP BY entry, hashValue""",
)
def p5_bucket_counts(spark, sf_dir):
    return skew.bucket_counts(read(spark, sf_dir, "hash_entries"))


# ---- statistics and encodings ----


@query(
    "num_stats",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dim, round(min({d}), 6) AS \"min\", round(max({d}), 6) AS \"max\", round(sum({d}), 2) AS \"sum\", round(sum({d} * {d}), 2) AS sum_sq, count({d}) AS \"count\", round(avg({d}), 6) AS mean, round(stddev_pop({d}), 6) AS std FROM lineitem"
        for d in ("l_quantity", "l_discount", "l_tax")
    ),
)
def num_stats(spark, sf_dir):
    s = profile.numeric_stats(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return s.select("dim", *(F.round(c, 2 if c.startswith("sum") else 6).alias(c) for c in ("min", "max", "sum", "sum_sq")), "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


LEX = "lex AS (SELECT dim, word, row_number() OVER (PARTITION BY dim ORDER BY word) - 1 AS id, n AS \"count\" FROM (SELECT 'o_orderstatus' AS dim, o_orderstatus AS word, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 2))"


@query("lexicon", f"WITH {LEX} SELECT * FROM lex")
def lexicon(spark, sf_dir):
    return profile.lexicon(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("nominal_combos", "SELECT o_orderstatus || ',' || o_orderpriority AS combo, count(*) AS \"count\" FROM orders GROUP BY 1")
def nominal_combos(spark, sf_dir):
    return profile.nominal_combos(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("nominal_mode", f"WITH {LEX} SELECT dim, min(id) AS min_id, max(id) AS max_id, count(*) AS cardinality, arg_max(id, \"count\" * 1000000 - id) AS mode_id FROM lex GROUP BY dim")
def nominal_mode(spark, sf_dir):
    return profile.nominal_summary(profile.lexicon(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("distinct_trajectories", "SELECT count(DISTINCT d_0) AS n_trajectories FROM traj_points")
def distinct_trajectories(spark, sf_dir):
    return profile.distinct_trajectories(read(spark, sf_dir, "traj_points"))


@query("point_ids", "SELECT CASE WHEN d_0 IS NOT NULL AND d_1 IS NOT NULL THEN d_0 || ',' || d_1 END AS rid, count(*) AS n FROM traj_points GROUP BY 1")
def point_ids(spark, sf_dir):
    return profile.with_rid(read(spark, sf_dir, "traj_points")).groupBy("rid").agg(F.count("*").alias("n"))


@query("nominal_columns", "SELECT * FROM (VALUES ('d_5'), ('d_6'), ('d_7')) t(col)")
def nominal_columns(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in io.nominal_columns(read(spark, sf_dir, "traj_points"))], "col string")


@query("cells_per_dim", f"WITH {EV} SELECT 'value' AS dim, CAST(trunc((max(value) - min(value)) / 10) AS BIGINT) + 1 AS n_cells FROM ev UNION ALL SELECT 'k', CAST(trunc((max(k) - min(k)) / 5) AS BIGINT) + 1 FROM ev")
def cells_per_dim(spark, sf_dir):
    return profile.cells_per_dim(profile.numeric_stats(events(spark, sf_dir), ["value", "k"]), {"value": 10, "k": 5})


@query("std_bins", "SELECT event_id, CAST(floor((value - (SELECT min(value) FROM events)) / (SELECT stddev_pop(value) FROM events)) AS BIGINT) AS bin_value FROM events")
def std_bins(spark, sf_dir):
    return profile.std_bins(events(spark, sf_dir), ["value"]).select("event_id", "bin_value")


@query("minmax_scaled", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS scaled FROM customer")
def minmax_scaled(spark, sf_dir):
    return profile.min_max_scaled(read(spark, sf_dir, "customer"), ["c_acctbal"]).select("c_custkey", F.round("scaled_c_acctbal", 6).alias("scaled"))


@query("descaled", "SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal FROM customer")
def descaled(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    back = profile.descaled(profile.min_max_scaled(c, ["c_acctbal"]), ["c_acctbal"], profile.numeric_stats(c, ["c_acctbal"]))
    return back.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


ACT = f"""{LEX}, st AS (SELECT min(o_totalprice) AS lo, stddev_pop(o_totalprice) AS sd FROM orders),
    enc AS (SELECT o_orderkey, CAST(floor((o_totalprice - lo) / sd) AS BIGINT) AS b, a.id AS s, p.id AS q FROM orders, st, lex a, lex p WHERE a.dim = 'o_orderstatus' AND a.word = o_orderstatus AND p.dim = 'o_orderpriority' AND p.word = o_orderpriority),
    w AS (SELECT max(b) + 1 AS wb, max(s) + 1 AS ws FROM enc),
    act AS (SELECT o_orderkey, [b, wb + s, wb + ws + q] AS active FROM enc, w)"""


def order_sets(spark, sf_dir):
    return profile.active_indexes(read(spark, sf_dir, "orders"), ["o_totalprice"], ["o_orderstatus", "o_orderpriority"])


@query("one_hot_sets", f"WITH {ACT} SELECT o_orderkey, array_to_string(active, ',') AS active FROM act")
def one_hot_sets(spark, sf_dir):
    return order_sets(spark, sf_dir).select("o_orderkey", F.array_join(F.transform("active", lambda x: x.cast("string")), ",").alias("active"))


@query("dense_features", f"WITH {LEX} SELECT o_orderkey, round(o_totalprice + a.id * 1000 + p.id, 4) AS checked FROM orders, lex a, lex p WHERE a.dim = 'o_orderstatus' AND a.word = o_orderstatus AND p.dim = 'o_orderpriority' AND p.word = o_orderpriority")
def dense_features(spark, sf_dir):
    t = profile.dense_features(read(spark, sf_dir, "orders"), ["o_totalprice"], ["o_orderstatus", "o_orderpriority"])
    return t.select("o_orderkey", F.round(F.col("features")[0] + F.col("features")[1] * 1000 + F.col("features")[2], 4).alias("checked"))


@query(
    "mixed_centroids",
    """WITH m AS (SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1), c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
    t AS (SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) AS r FROM c)
    SELECT m.o_orderstatus, m.n, m.o_totalprice, t.o_orderpriority FROM m JOIN t ON m.o_orderstatus = t.o_orderstatus AND r = 1""",
)
def mixed_centroids(spark, sf_dir):
    return profile.mixed_centroid(read(spark, sf_dir, "orders"), "o_orderstatus", ["o_totalprice"], ["o_orderpriority"]).select("o_orderstatus", "n", F.round("o_totalprice", 4).alias("o_totalprice"), "o_orderpriority")


@query("pairwise_cost", "SELECT o_orderstatus, count(*) AS n, round(count(*) * (count(*) * var_pop(o_totalprice / 1000)), 0) AS cost FROM orders GROUP BY 1")
def pairwise_cost(spark, sf_dir):
    """Sum over all pairs of orders of a status of their squared price difference, in thousands."""
    o = read(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_totalprice") / 1000).alias("p"))
    return profile.pairwise_cost(o, "o_orderstatus", ["p"]).select("o_orderstatus", "n", F.round("cost", 0).alias("cost"))


@query(
    "value_histogram",
    """WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 16)), 15) AS INT) AS b, count(*) AS n FROM lineitem, s GROUP BY 1)
    SELECT round(lo + r.i * ((hi - lo) / 16), 6) AS lo, round(CASE WHEN r.i = 15 THEN hi ELSE lo + (r.i + 1) * ((hi - lo) / 16) END, 6) AS hi, coalesce(n, 0) AS "count" FROM s, range(16) r(i) LEFT JOIN b ON b.b = r.i""",
)
def value_histogram(spark, sf_dir):
    return profile.histogram(read(spark, sf_dir, "lineitem"), "l_quantity").select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count")


# ---- grid cells ----


@query(
    "grid_counts",
    """WITH p AS (SELECT d_2, d_3 FROM traj_points WHERE isfinite(d_2) AND isfinite(d_3)), m AS (SELECT (SELECT min(d_2) FROM traj_points WHERE isfinite(d_2)) AS a, (SELECT min(d_3) FROM traj_points WHERE isfinite(d_3)) AS b)
    SELECT CAST(CAST(trunc((d_2 - a) / 500) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(trunc((d_3 - b) / 500) AS BIGINT) AS VARCHAR) AS cell, count(*) AS n FROM p, m GROUP BY 1""",
)
def grid_counts(spark, sf_dir):
    t = grid.offset_cells(read(spark, sf_dir, "traj_points"), {"d_2": 500, "d_3": 500})
    return grid.cell_counts(t).select(grid.cell_name().alias("cell"), "n")


@query("cell_ids", """WITH m AS (SELECT min(d_2) AS a, min(d_3) AS b FROM traj_points WHERE isfinite(d_2) AND isfinite(d_3)), c AS (SELECT DISTINCT CAST(trunc((d_2 - (SELECT min(d_2) FROM traj_points WHERE isfinite(d_2))) / 500) AS BIGINT) AS x, CAST(trunc((d_3 - (SELECT min(d_3) FROM traj_points WHERE isfinite(d_3))) / 500) AS BIGINT) AS y FROM traj_points WHERE isfinite(d_2) AND isfinite(d_3))
    SELECT x || ',' || y AS cell, row_number() OVER (ORDER BY x, y) AS cell_id FROM c""")
def cell_ids(spark, sf_dir):
    t = grid.offset_cells(read(spark, sf_dir, "traj_points"), {"d_2": 500, "d_3": 500})
    return grid.cell_ids(t).select(grid.cell_name().alias("cell"), "cell_id")


@query("patchwork_cells", "SELECT p_partkey, CAST(ceil(p_size / 5.0) AS BIGINT) || ',' || CAST(ceil(p_retailprice / 10.0) AS BIGINT) AS cell FROM part")
def patchwork_cells(spark, sf_dir):
    return grid.ceil_cells(read(spark, sf_dir, "part"), {"p_size": 5, "p_retailprice": 10}).select("p_partkey", grid.cell_name().alias("cell"))


@query("first_cell_owner", "SELECT l_returnflag, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1")
def first_cell_owner(spark, sf_dir):
    return grid.given_ids(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey")


# ---- distances ----


@query(
    "rv_distances",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT a.vec_id AS id1, b.vec_id AS id2, round(1 - list_dot_product(a.v, b.v) ** 2 / (list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS dist FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <= b.vec_id""",
)
def rv_distances(spark, sf_dir):
    """RV distances of a stated query set (every fiftieth id) to all rows, a block of queries at a time."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return pairs.block_distances(e.where("id % 50 = 0"), e, "RV", once=True).withColumn("dist", F.round("dist", 6))


@query(
    "rv_query_distances",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT a.vec_id AS id1, b.vec_id AS id2, round(1 - list_dot_product(a.v, b.v) ** 2 / (list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS dist FROM e a JOIN e b ON a.vec_id % 50 = 0""",
)
def rv_query_distances(spark, sf_dir):
    """RV distances of each query (every fiftieth id) to every row, also those of a smaller id, which
    rv_distances and its SQL leave out."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return pairs.block_distances(e.where("id % 50 = 0"), e, "RV").withColumn("dist", F.round("dist", 6))


@query(
    "vector_algebra",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT vec_id, round(list_sum(v), 6) AS total, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_min(v), 6) AS low, list_position(v, list_max(v)) - 1 AS at_high, round(list_sum(list_transform(v, lambda x: (x * 2 - 1) * (x * 2 - 1))), 6) AS squares, round(list_sum(list_transform(v, lambda x: exp(x))), 6) AS exps, round(list_sum(v[3:6]), 6) AS part FROM e""",
)
def vector_algebra(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    two = A.sub(A.mul("v", 2.0), 1.0)
    return v.select("vec_id", F.round(A.total("v"), 6).alias("total"), F.round(A.norm("v"), 6).alias("norm"), F.round(A.least("v"), 6).alias("low"), A.largest_index("v").alias("at_high"), F.round(A.dot(two, two), 6).alias("squares"), F.round(A.total(A.exp("v")), 6).alias("exps"), F.round(A.total(A.part("v", 2, 6)), 6).alias("part"))


@query(
    "distance_functions",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), t AS (SELECT vec_id, v, list_sum(v) AS s, sqrt(list_dot_product(v, v)) AS n FROM e)
    SELECT vec_id, round(sqrt(n * n - 2 * s + 64), 6) AS euclid, round(s / sqrt(n * n * 64), 6) AS flat, round(list_sum(list_transform(v, lambda x: abs(x - 1))), 6) AS manhattan, round(list_max(list_transform(v, lambda x: abs(x - 1))), 6) AS chebyshev,
    CASE WHEN floor(v[1] * 2) = floor(v[3] * 2) OR floor(v[2] * 2) = floor(v[4] * 2) THEN 0 ELSE 1 END AS hashes, v[1] BETWEEN -0.1 AND 0.1 AND v[2] BETWEEN 0.0 AND 0.2 AS closed, v[1] > -0.1 AND v[1] < 0.1 AND v[2] > 0.0 AND v[2] < 0.2 AS open, true AS same, false AS other FROM t""",
)
def distance_functions(spark, sf_dir):
    """Distances to the vector of ones, least hash distance of two pairs of entries, boxes, tolerant equality."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("x", F.col("v")[0]).withColumn("y", F.col("v")[1])
    half = lambda i: F.floor(F.col("v")[i] * 2)
    box = lambda closed: A.within(["x", "y"], [-0.1, 0.0], [0.1, 0.2], closed)
    return v.select("vec_id", F.round(A.euclidean("v", A.ones(64)), 6).alias("euclid"), F.round(A.rv_flat("v", A.ones(64)), 6).alias("flat"), F.round(A.manhattan("v", A.ones(64)), 6).alias("manhattan"), F.round(A.chebyshev("v", A.ones(64)), 6).alias("chebyshev"),
        A.hash_distance(F.array(half(0), half(1)), F.array(half(2), half(3))).alias("hashes"), box(True).alias("closed"), box(False).alias("open"), A.almost_equal("x", F.col("x") + 1e-12).alias("same"), A.almost_equal("x", F.col("x") + 1e-6).alias("other"))


@query(
    "jaccard_pairs",
    """WITH s AS (SELECT rid, list_sort(list_distinct(list_filter(features, lambda x: x IS NOT NULL))) AS f FROM area_sets), t AS (SELECT rid, f, unnest(f) AS x FROM s)
    SELECT a.rid AS a, b.rid AS b, round(1 - count(*) / (any_value(len(a.f)) + any_value(len(b.f)) - count(*)), 6) AS dist FROM t a JOIN t b ON a.x = b.x AND a.rid < b.rid GROUP BY 1, 2 HAVING dist < 0.95""",
)
def jaccard_pairs(spark, sf_dir):
    """Pairs of the fixed reference sets closer than 0.95, met through shared elements."""
    s = read(spark, sf_dir, "area_sets").select("rid", F.array_distinct(F.filter("features", lambda x: x.isNotNull())).alias("f"))
    t = s.select("rid", F.size("f").alias("n"), F.explode("f").alias("x"))
    both = t.select(F.col("rid").alias("a"), F.col("n").alias("na"), "x").join(t.select(F.col("rid").alias("b"), F.col("n").alias("nb"), "x"), "x").where("a < b")
    c = both.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return c.select("a", "b", F.round(1 - F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("dist")).where("dist < 0.95")


# ---- min-hash ----

HASHES = ", ".join(f"list_min(list_transform(active, lambda e: ((1 + e) * {a} + {b}) % {lsh.PRIME}))" for a, b in AB)
CLS = f"""{ACT}, cls AS (SELECT active, min(o_orderkey) AS class_id, count(*) AS n FROM act GROUP BY active), sig AS (SELECT class_id, active, n, [{HASHES}] AS h FROM cls),
    bk AS (SELECT class_id, active, n, e.i AS entry, h[e.i + 1] AS hashValue FROM sig, range({len(AB)}) e(i))"""
JAC = "1 - len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))"


@query("minhash_signature", f"WITH {ACT} SELECT o_orderkey, array_to_string([{HASHES}], ',') AS sig FROM act")
def minhash_signature(spark, sf_dir):
    return order_sets(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(lsh.min_hash("active", AB), lambda x: x.cast("string")), ",").alias("sig"))


@query("lsh_bucket_join", f"WITH {CLS} SELECT a.class_id AS id_a, b.class_id AS id_b, CAST(a.entry AS INT) AS entry, a.hashValue, round({JAC.format(a='a.active', b='b.active')}, 6) AS dist FROM bk a JOIN bk b ON a.entry = b.entry AND a.hashValue = b.hashValue AND a.class_id < b.class_id WHERE {JAC.format(a='a.active', b='b.active')} < 0.8")
def lsh_bucket_join(spark, sf_dir):
    classes, _ = lsh.set_classes(order_sets(spark, sf_dir), "o_orderkey")
    return lsh.bucket_join(classes, AB, 0.8).withColumn("dist", F.round("dist", 6))


SETS_AB = """fs AS (SELECT rid, list_sort(list_distinct(list_filter(features, lambda x: x IS NOT NULL))) AS active FROM set_features WHERE rid IS NOT NULL), ls AS (SELECT CAST(active AS BIGINT[]) AS active, min(rid) AS id FROM fs WHERE len(active) > 0 GROUP BY active),
    ga AS (SELECT rid, list_sort(list_distinct(list_filter(features, lambda x: x IS NOT NULL))) AS active FROM area_sets WHERE rid IS NOT NULL), rs AS (SELECT CAST(active AS BIGINT[]) AS active, min(rid) AS id FROM ga WHERE len(active) > 0 GROUP BY active)"""


@query(
    "lsh_join",
    f"""WITH {SETS_AB}, lh AS (SELECT id, active, [{HASHES}] AS h FROM ls), rh AS (SELECT id, active, [{HASHES}] AS h FROM rs),
    lb AS (SELECT id, e.i AS entry, h[e.i + 1] AS hv FROM lh, range({len(AB)}) e(i)), rb AS (SELECT id, e.i AS entry, h[e.i + 1] AS hv FROM rh, range({len(AB)}) e(i)),
    p AS (SELECT lb.id AS a, rb.id AS b, lb.entry, lb.hv FROM lb JOIN rb ON lb.entry = rb.entry AND lb.hv = rb.hv), k AS (SELECT DISTINCT a, b FROM p),
    d AS (SELECT a, b, {JAC.format(a='x.active', b='y.active')} AS dist FROM k JOIN ls x ON x.id = a JOIN rs y ON y.id = b)
    SELECT p.a AS id_a, p.b AS id_b, CAST(p.entry AS INT) AS entry, p.hv AS "hashValue", round(d.dist, 6) AS dist FROM p JOIN d ON p.a = d.a AND p.b = d.b WHERE d.dist < 0.6""",
)
def lsh_join(spark, sf_dir):
    """Sets of set_features and area_sets that share a bucket and are closer than 0.6."""
    sets = [lsh.set_classes(read(spark, sf_dir, t).select("rid", F.col("features").alias("active")), "rid")[0] for t in ("set_features", "area_sets")]
    return lsh.join(*sets, AB, 0.6).withColumn("dist", F.round("dist", 6))


@query("lsh_knn", f"WITH {CLS}, p AS (SELECT DISTINCT a.class_id AS id, b.class_id AS other, {JAC.format(a='a.active', b='b.active')} AS dist FROM bk a JOIN bk b ON a.entry = b.entry AND a.hashValue = b.hashValue AND a.class_id <> b.class_id) SELECT id, other, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS r FROM p) WHERE r <= 3")
def lsh_knn(spark, sf_dir):
    classes, _ = lsh.set_classes(order_sets(spark, sf_dir), "o_orderkey")
    return lsh.nearest_per_row(classes, AB, 3).withColumn("dist", F.round("dist", 6))


@query("lsh_key_search", f"WITH {CLS}, q AS (SELECT active AS k FROM cls WHERE class_id = (SELECT min(class_id) FROM cls)) SELECT DISTINCT class_id, n, round({JAC.format(a='active', b='k')}, 6) AS dist FROM bk, q, (SELECT entry AS e2, hashValue AS h2 FROM bk WHERE class_id = (SELECT min(class_id) FROM cls)) WHERE entry = e2 AND hashValue = h2 ORDER BY dist, class_id LIMIT 5")
def lsh_key_search(spark, sf_dir):
    """The five sets nearest to the first one (a top-k search)."""
    classes, _ = lsh.set_classes(order_sets(spark, sf_dir), "o_orderkey")
    key = classes.orderBy("class_id").head()["active"]
    return lsh.approx_nearest(classes, key, 5, AB).withColumn("dist", F.round("dist", 6))


def _areas_sql(edges: str) -> str:
    return f"""WITH RECURSIVE {CLS}, e AS ({edges}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(x, g) AS (SELECT class_id, class_id FROM cls UNION SELECT u.b, r.g FROM r JOIN u ON u.a = r.x AND r.g < u.b), comp AS (SELECT x, min(g) AS g FROM r GROUP BY x)
    SELECT o_orderkey AS rid, CAST(dense_rank() OVER (ORDER BY g) AS INT) AS area_id FROM act JOIN cls USING (active) JOIN comp ON comp.x = cls.class_id"""


@query("minhash_areas_bucket", _areas_sql("SELECT a.class_id AS a, b.class_id AS b FROM bk a JOIN bk b ON a.entry = b.entry AND a.hashValue = b.hashValue"))
def minhash_areas_bucket(spark, sf_dir):
    return areas.min_hash_areas(order_sets(spark, sf_dir), "o_orderkey", "active", AB)


@query("minhash_areas_pairwise", _areas_sql(f"SELECT a.class_id AS a, b.class_id AS b FROM bk a JOIN bk b ON a.entry = b.entry AND a.hashValue = b.hashValue WHERE {JAC.format(a='a.active', b='b.active')} < 0.5"))
def minhash_areas_pairwise(spark, sf_dir):
    return areas.min_hash_areas(order_sets(spark, sf_dir), "o_orderkey", "active", AB, threshold=0.5, pairwise=True)


@query(
    "match_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT rid_a AS a, rid_b AS b FROM match_pairs WHERE rid_a IS NOT NULL AND rid_b IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(id, g) AS (SELECT a, a FROM u UNION SELECT u.b, r.g FROM r JOIN u ON u.a = r.id AND r.g < u.b) SELECT id, min(g) AS component FROM r GROUP BY id""",
)
def match_components(spark, sf_dir):
    return connected_components(read(spark, sf_dir, "match_pairs"), "rid_a", "rid_b")


# ---- sequences ----

VIS = f"{EV}, lx AS (SELECT event_type AS w, row_number() OVER (ORDER BY event_type) AS area FROM ev GROUP BY 1), v AS (SELECT DISTINCT user_id AS traj, t, CAST(area AS INT) AS area FROM ev JOIN lx ON w = event_type), mc AS (SELECT greatest(1, ceil(0.4 * count(DISTINCT traj) - 1e-9)) AS need FROM v)"


def event_visits(spark, sf_dir):
    ev = profile.lexicon_ids(events(spark, sf_dir), ["event_type"])
    return sequences.visits(ev.withColumn("area", F.col("id_event_type") + 1).withColumn("zero", F.lit(0.0)), "user_id", "t", "area", ["value", "k", "zero"])


@query("sequences", f"WITH {VIS} SELECT traj, string_agg(t || ':' || area, ' ' ORDER BY t, area) AS items FROM v GROUP BY traj")
def seqs(spark, sf_dir):
    s = sequences.sequences(event_visits(spark, sf_dir))
    return s.select("traj", F.array_join(F.transform("items", lambda i: F.concat(i["time"].cast("string"), F.lit(":"), i["area_id"].cast("string"))), " ").alias("items"))


@query("nested_rows", """WITH r AS (SELECT d_0, unnest(items) AS i, generate_subscripts(items, 1) - 1 AS pos FROM traj_items) SELECT d_0, CAST(pos AS INT) AS items_pos, i.time AS items_time, i.area_id AS items_area_id, count(*) AS n FROM r GROUP BY ALL""")
def nested_rows(spark, sf_dir):
    """The nested items as table rows, counted, as several rows may repeat."""
    t = read(spark, sf_dir, "traj_items").select("d_0", F.transform("items", lambda i: F.struct(i["time"].alias("time"), i["area_id"].alias("area_id"))).alias("items"))
    return io.flat_rows(t).groupBy("d_0", "items_pos", "items_time", "items_area_id").agg(F.count("*").alias("n"))


@query("frequent_items", f"WITH {VIS} SELECT area, count(DISTINCT traj) AS support FROM v, mc GROUP BY area, need HAVING count(DISTINCT traj) >= need")
def frequent_items(spark, sf_dir):
    v = event_visits(spark, sf_dir)
    return sequences.frequent_items(v, sequences.min_count(v, 0.4))


def _gap_sql(most: int) -> str:
    return f"""WITH RECURSIVE {VIS}, g(pattern, k, traj, last) AS (SELECT CAST(area AS VARCHAR), 1, traj, t FROM v UNION SELECT g.pattern || ',' || v.area, g.k + 1, g.traj, v.t FROM g JOIN v ON v.traj = g.traj AND v.t > g.last AND v.t - g.last <= {HALF_DAY_US} WHERE g.k < {most})
    SELECT pattern, CAST(k AS INT) AS length, count(DISTINCT traj) AS support FROM g, mc WHERE k >= 2 GROUP BY pattern, k, need HAVING count(DISTINCT traj) >= need"""


def _gap(spark, sf_dir, most):
    return sequences.gap_patterns(event_visits(spark, sf_dir), 0.4, HALF_DAY_US, most).select(sequences.pattern_text().alias("pattern"), "length", "support")


@query("gap_patterns_len2", _gap_sql(2))
def gap_patterns_len2(spark, sf_dir):
    return _gap(spark, sf_dir, 2)


@query("gap_patterns_len3", _gap_sql(3))
def gap_patterns_len3(spark, sf_dir):
    return _gap(spark, sf_dir, 3)


@query("gap_patterns_all", _gap_sql(4))
def gap_patterns_all(spark, sf_dir):
    """All frequent patterns, however long."""
    return _gap(spark, sf_dir, 100)


@query(
    "ungapped_prefixspan",
    f"""WITH {VIS}, b AS (SELECT DISTINCT traj, t // {DAY_US} AS d, area FROM v), n AS (SELECT ceil(0.4 * count(DISTINCT traj)) AS need FROM b), p AS (
      SELECT CAST(area AS VARCHAR) AS pattern, traj FROM b UNION SELECT x.area || ' ' || y.area, x.traj FROM b x JOIN b y ON x.traj = y.traj AND x.d = y.d AND x.area < y.area UNION SELECT x.area || '|' || y.area, x.traj FROM b x JOIN b y ON x.traj = y.traj AND x.d < y.d)
    SELECT pattern, count(*) AS freq FROM p, n GROUP BY pattern, need HAVING count(*) >= need""",
)
def ungapped_prefixspan(spark, sf_dir):
    d = event_visits(spark, sf_dir).select("traj", F.floor(F.col("t") / DAY_US).alias("d"), "area").distinct()
    days = d.groupBy("traj", "d").agg(F.sort_array(F.collect_list("area")).alias("s"))
    seqs = days.groupBy("traj").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("sequence"))
    found = sequences.ungapped_patterns(seqs, 0.4, 2)
    return found.select(F.array_join(F.transform("sequence", lambda s: F.array_join(F.transform(F.array_sort(s), lambda x: x.cast("string")), " ")), "|").alias("pattern"), "freq")


def _instances(spark, sf_dir, most=3):
    v = event_visits(spark, sf_dir)
    return sequences.pattern_instances(v, sequences.gap_patterns(v, 0.4, HALF_DAY_US, most), HALF_DAY_US, 3)


@query("pattern_instances")
def pattern_instances(spark, sf_dir):
    return _instances(spark, sf_dir)


@query("transitions")
def transitions(spark, sf_dir):
    return sequences.transitions(_instances(spark, sf_dir))


@query("transition_clusters")
def transition_clusters(spark, sf_dir):
    return sequences.cluster_transitions(sequences.transitions(_instances(spark, sf_dir)), bandwidth=200.0, merge_window=1.0, max_iterations=30)


@query("transition_dbscan")
def transition_dbscan(spark, sf_dir):
    return sequences.cluster_transitions_dbscan(sequences.transitions(_instances(spark, sf_dir)), eps=40.0, min_pts=3)


@query("transition_vectors")
def transition_vectors(spark, sf_dir):
    """Mean shift on hash slices over the transitions of all patterns, those of each length on their own."""
    tr = sequences.transitions(_instances(spark, sf_dir, 100))
    points = tr.select("length", F.concat_ws("|", "pattern", F.col("traj").cast("string"), F.col("n").cast("string")).alias("id"), "v")
    return sequences.cluster_vectors_by_length(points, 3, iterations=3)


@query("pattern_pipeline")
def pattern_pipeline(spark, sf_dir):
    """Points of traj_points to areas by activity and mode, patterns, and their clustered transitions counted."""
    p = pipeline.nominal_areas_input(read(spark, sf_dir, "traj_points"), [], ["d_6", "d_7"])
    run = pipeline.mine(p, "MINHASHLSH", {"active": "active", "ab": AB, "threshold": 0.5, "pairwise": True})
    return pipeline.summary(run)


# ---- hotspots ----

HS = f"""{EV}, b AS (SELECT min(value) AS x0, max(value) AS x1, min(k) AS y0, max(k) AS y1, min(t) AS t0, max(t) AS t1 FROM ev), g AS (SELECT *, CAST(greatest(1, ceil((x1 - x0) / 25)) AS BIGINT) AS nx, CAST(greatest(1, ceil((y1 - y0) / 25.0)) AS BIGINT) AS ny, CAST(greatest(1, ceil((t1 - t0) / {DAY_US}.0)) AS BIGINT) AS nt FROM b),
    c AS (SELECT user_id, t, least(CAST(trunc((value - x0) / 25) AS BIGINT), nx - 1) AS cx, least(CAST(trunc((k - y0) / 25.0) AS BIGINT), ny - 1) AS cy, least((t - t0) // {DAY_US}, nt - 1) AS ct FROM ev, g),
    dw AS (SELECT cx, cy, ct, sum(d) AS x FROM (SELECT cx, cy, ct, user_id, (max(t) - min(t)) / {DAY_US}.0 AS d FROM c GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3), ms AS (SELECT nx * ny * nt AS n, coalesce((SELECT sum(x) FROM dw), 0) / (nx * ny * nt) AS m, coalesce((SELECT sum(x * x) FROM dw), 0) / (nx * ny * nt) AS q FROM g)"""


def _hot(spark, sf_dir):
    p = hotspot.usable(events(spark, sf_dir), "user_id", "value", "k", "t")
    return p, hotspot.extent(p, 25, DAY_US)


@query("dwell_per_cell", f"WITH {HS} SELECT cx + cy * nx + ct * nx * ny AS cell_id, round(x, 6) AS x FROM dw, g")
def dwell_per_cell(spark, sf_dir):
    p, e = _hot(spark, sf_dir)
    return hotspot.dwell(p, e).select("cell_id", F.round("x", 6).alias("x"))


@query("grid_mean_std", f"WITH {HS} SELECT round(m, 6) AS mean, round(sqrt(greatest(q - m * m, 0)), 6) AS std FROM ms")
def grid_mean_std(spark, sf_dir):
    p, e = _hot(spark, sf_dir)
    return hotspot.mean_std(hotspot.dwell(p, e), e).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


GI = f"""{HS}, o AS (SELECT i - 2 AS o FROM range(5) r(i)), nb AS (SELECT cx + a.o AS x, cy + b.o AS y, ct + c.o AS t, dw.x AS v, greatest(abs(a.o), abs(b.o), abs(c.o)) AS ring FROM dw, o a, o b, o c, g WHERE cx + a.o BETWEEN 0 AND nx - 1 AND cy + b.o BETWEEN 0 AND ny - 1 AND ct + c.o BETWEEN 0 AND nt - 1),
    wx AS (SELECT x, y, t, sum(v * CASE WHEN ring = 0 THEN 1 ELSE pow(2, 1 - ring) END) AS s FROM nb GROUP BY 1, 2, 3),
    ww AS (SELECT x, y, t, any_value(s) AS s, sum(CASE WHEN r = 0 THEN 1 ELSE pow(2, 1 - r) END) AS w1, sum(CASE WHEN r = 0 THEN 1 ELSE pow(4, 1 - r) END) AS w2 FROM (SELECT wx.*, greatest(abs(a.o), abs(b.o), abs(c.o)) AS r FROM wx, o a, o b, o c, g WHERE wx.x + a.o BETWEEN 0 AND nx - 1 AND wx.y + b.o BETWEEN 0 AND ny - 1 AND wx.t + c.o BETWEEN 0 AND nt - 1) GROUP BY 1, 2, 3),
    z AS (SELECT x + y * nx + t * nx * ny AS cell_id, (s - m * w1) / nullif(sqrt(greatest(q - m * m, 0)) * sqrt((n * w2 - w1 * w1) / (n - 1)), 0) AS z FROM ww, ms, g)"""


@query("getis_ord", f"WITH {GI} SELECT cell_id, round(z, 6) AS z FROM z")
def getis_ord(spark, sf_dir):
    p, e = _hot(spark, sf_dir)
    return hotspot.gi_star(hotspot.dwell(p, e), e, 2).select("cell_id", F.round("z", 6).alias("z"))


@query("getis_ord_topk", f"WITH {GI} SELECT cell_id, round(z, 6) AS z FROM z WHERE z IS NOT NULL ORDER BY z.z DESC, cell_id LIMIT 50")
def getis_ord_topk(spark, sf_dir):
    p, e = _hot(spark, sf_dir)
    return hotspot.top_hotspots(hotspot.gi_star(hotspot.dwell(p, e), e, 2), 50).select("cell_id", F.round("z", 6).alias("z"))


@query("hotspot_pipeline", f"WITH {GI} SELECT cell_id, round(z, 6) AS z, CAST(cell_id % nx AS BIGINT) AS cx, CAST((cell_id // nx) % ny AS BIGINT) AS cy, CAST(cell_id // (nx * ny) AS BIGINT) AS ct FROM z, g WHERE z IS NOT NULL ORDER BY z.z DESC, cell_id LIMIT 50")
def hotspot_pipeline(spark, sf_dir):
    return pipeline.hotspots(events(spark, sf_dir), "user_id", "value", "k", "t", 25, DAY_US, 2, 50).select("cell_id", F.round("z", 6).alias("z"), "cx", "cy", "ct")


@query("hotspot_times", f"WITH {GI} SELECT cell_id, CAST(t0 + (cell_id // (nx * ny)) * {DAY_US} AS BIGINT) AS t_from, CAST(t0 + (cell_id // (nx * ny) + 1) * {DAY_US} AS BIGINT) AS t_to FROM z, g WHERE z IS NOT NULL ORDER BY z.z DESC, cell_id LIMIT 50")
def hotspot_times(spark, sf_dir):
    """First and last time of the 50 highest cells."""
    return pipeline.hotspots(events(spark, sf_dir), "user_id", "value", "k", "t", 25, DAY_US, 2, 50).select("cell_id", "t_from", "t_to")


# ---- density clustering ----

EPS, PTS = 0.75, 9
PT = "p AS (SELECT event_id, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) * 0.6 AS y FROM events), vt AS (SELECT x, y, count(*) AS w FROM p GROUP BY 1, 2)"
NB = f"{PT}, nb AS (SELECT a.x, a.y, any_value(a.w) AS w, sum(b.w) AS n, min(CASE WHEN a.x <> b.x OR a.y <> b.y THEN sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) WHEN a.w > 1 THEN 0 END) AS d FROM vt a JOIN vt b ON b.x BETWEEN a.x - {EPS + 0.01} AND a.x + {EPS + 0.01} AND b.y BETWEEN a.y - {EPS + 0.01} AND a.y + {EPS + 0.01} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS} GROUP BY 1, 2)"


def event_points(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.col("value").alias("x"), (F.col("k").cast("double") * F.lit(0.6)).alias("y"))


@query("dbscan_core_counts", f"WITH {NB} SELECT round(x, 6) AS x, round(y, 6) AS y, w, CAST(n AS BIGINT) AS n, n >= {PTS} AS core FROM nb")
def dbscan_core_counts(spark, sf_dir):
    c = db.neighbour_counts(db.vertices(event_points(spark, sf_dir), ["x", "y"]), 2, EPS)
    return c.select(F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"), "w", "n", (F.col("n") >= PTS).alias("core"))


CORE = f"""{NB}, co AS (SELECT x, y, row_number() OVER (ORDER BY x, y) AS i FROM nb WHERE n >= {PTS}),
    ed AS (SELECT a.i AS a, b.i AS b FROM co a JOIN co b ON b.x BETWEEN a.x - {EPS + 0.01} AND a.x + {EPS + 0.01} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS} AND a.i <> b.i),
    r(i, g) AS (SELECT i, i FROM co UNION SELECT ed.b, r.g FROM r JOIN ed ON ed.a = r.i AND r.g < ed.b), cl AS (SELECT i, dense_rank() OVER (ORDER BY g) AS cluster FROM (SELECT i, min(g) AS g FROM r GROUP BY i)),
    lab AS (SELECT x, y, cluster, 'CORE' AS kind FROM co JOIN cl USING (i) UNION ALL SELECT n.x, n.y, min(cluster), 'BORDER' FROM nb n JOIN co ON n.n < {PTS} AND (n.x - co.x) * (n.x - co.x) + (n.y - co.y) * (n.y - co.y) <= {EPS * EPS} JOIN cl USING (i) GROUP BY 1, 2)"""


@query("dbscan_labels", f"WITH RECURSIVE {CORE} SELECT event_id, CAST(coalesce(cluster, 0) AS BIGINT) AS cluster, coalesce(kind, 'NOISE') AS kind FROM p LEFT JOIN lab USING (x, y)")
def dbscan_labels(spark, sf_dir):
    return db.dbscan(event_points(spark, sf_dir), ["x", "y"], EPS, PTS).select("event_id", "cluster", "kind")


@query("dbscan_border_as_noise", f"WITH RECURSIVE {CORE} SELECT event_id, CAST(coalesce(cluster, 0) AS BIGINT) AS cluster, coalesce(kind, 'NOISE') AS kind FROM p LEFT JOIN (SELECT * FROM lab WHERE kind = 'CORE') USING (x, y)")
def dbscan_border_as_noise(spark, sf_dir):
    return db.dbscan(event_points(spark, sf_dir), ["x", "y"], EPS, PTS, border_as_noise=True).select("event_id", "cluster", "kind")


@query("dbscan_noise", f"WITH RECURSIVE {CORE} SELECT event_id FROM p LEFT JOIN lab USING (x, y) WHERE cluster IS NULL")
def dbscan_noise(spark, sf_dir):
    return db.noise(db.dbscan(event_points(spark, sf_dir), ["x", "y"], EPS, PTS)).select("event_id")


@query("dbscan_areas", f"WITH RECURSIVE {CORE} SELECT event_id AS rid, CAST(coalesce(cluster, 0) AS INT) AS area_id FROM p LEFT JOIN lab USING (x, y)")
def dbscan_areas(spark, sf_dir):
    return areas.discover("DBSCAN", event_points(spark, sf_dir), "event_id", cols=["x", "y"], eps=EPS, min_pts=PTS)


@query(
    "dbscan_predict",
    f"""WITH RECURSIVE {CORE}, full_l AS (SELECT x, y, coalesce(cluster, 0) AS cluster, count(*) AS w FROM p LEFT JOIN lab USING (x, y) GROUP BY 1, 2, 3), q AS (SELECT s_suppkey AS id, abs(s_acctbal) / 300 AS x, s_nationkey * 2.4 AS y FROM supplier),
    c AS (SELECT id, cluster, sum(w) AS n FROM q JOIN full_l f ON (q.x - f.x) * (q.x - f.x) + (q.y - f.y) * (q.y - f.y) <= {EPS * EPS} GROUP BY 1, 2),
    s AS (SELECT id, max(CASE WHEN cluster > 0 THEN n * 1000000 - cluster END) AS top, sum(CASE WHEN cluster = 0 THEN n ELSE 0 END) AS quiet FROM c GROUP BY id), t AS (SELECT id, top, quiet, (SELECT min(cluster) FROM c WHERE c.id = s.id AND cluster > 0 AND n * 1000000 - cluster = top) AS cluster FROM s)
    SELECT q.id, CAST(CASE WHEN top IS NOT NULL THEN cluster WHEN quiet >= {PTS - 1} THEN -1 ELSE 0 END AS BIGINT) AS prediction FROM q LEFT JOIN t USING (id)""",
)
def dbscan_predict(spark, sf_dir):
    labelled = db.dbscan(event_points(spark, sf_dir), ["x", "y"], EPS, PTS)
    q = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.abs("s_acctbal") / 300).alias("x"), (F.col("s_nationkey") * F.lit(2.4)).alias("y"))
    return db.predict(labelled, ["x", "y"], q, "id", EPS, PTS)


def _hist_sql(col: str, where: str) -> str:
    return f"""WITH {NB}, h AS (SELECT CAST({col} AS DOUBLE) AS c FROM nb WHERE {where}), s AS (SELECT min(c) AS lo, max(c) AS hi FROM h), b AS (SELECT CAST(least(floor((c - lo) / ((hi - lo) / 16)), 15) AS INT) AS b, count(*) AS n FROM h, s GROUP BY 1)
    SELECT round(lo + r.i * ((hi - lo) / 16), 6) AS lo, round(CASE WHEN r.i = 15 THEN hi ELSE lo + (r.i + 1) * ((hi - lo) / 16) END, 6) AS hi, coalesce(n, 0) AS "count" FROM s, range(16) r(i) LEFT JOIN b ON b.b = r.i"""


@query("within_eps_hist", _hist_sql("CASE WHEN n = 1 THEN 0 ELSE n END", "true"))
def within_eps_hist(spark, sf_dir):
    return db.within_eps_histogram(event_points(spark, sf_dir), ["x", "y"], EPS).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count")


@query("nn_distance_hist", _hist_sql("d", "d IS NOT NULL"))
def nn_distance_hist(spark, sf_dir):
    return db.nearest_histogram(event_points(spark, sf_dir), ["x", "y"], EPS).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count")


def _row_hist_sql(h: str) -> str:
    return f"""WITH {NB}, h AS ({h}), s AS (SELECT min(c) AS lo, max(c) AS hi FROM h), b AS (SELECT CAST(least(floor((c - lo) / ((hi - lo) / 16)), 15) AS INT) AS b, CAST(sum(w) AS BIGINT) AS n FROM h, s GROUP BY 1)
    SELECT round(lo + r.i * ((hi - lo) / 16), 6) AS lo, round(CASE WHEN r.i = 15 THEN hi ELSE lo + (r.i + 1) * ((hi - lo) / 16) END, 6) AS hi, coalesce(n, 0) AS "count" FROM s, range(16) r(i) LEFT JOIN b ON b.b = r.i"""


@query("within_eps_row_hist", _row_hist_sql("SELECT CAST(CASE WHEN n = 1 THEN 0 ELSE n END AS DOUBLE) AS c, w FROM nb"))
def within_eps_row_hist(spark, sf_dir):
    return db.within_eps_row_histogram(event_points(spark, sf_dir), ["x", "y"], EPS).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count")


@query("nn_distance_row_hist", _row_hist_sql("SELECT d AS c, w FROM nb WHERE d IS NOT NULL UNION ALL SELECT min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), any_value(a.w) FROM nb a JOIN vt b ON a.d IS NULL AND (a.x <> b.x OR a.y <> b.y) GROUP BY a.x, a.y"))
def nn_distance_row_hist(spark, sf_dir):
    return db.nearest_row_histogram(event_points(spark, sf_dir), ["x", "y"], EPS).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count")


PW = """cells AS (SELECT CAST(ceil(p_size / 5.0) AS BIGINT) AS a, CAST(ceil(p_retailprice / 10.0) AS BIGINT) AS b, count(*) AS n FROM part GROUP BY 1, 2), c AS (SELECT a, b, n, row_number() OVER (ORDER BY n, a, b) AS rk FROM cells WHERE n >= {pts}),
    ln AS (SELECT u.rk AS u, v.rk AS v FROM c u JOIN c v ON abs(u.a - v.a) <= 1 AND abs(u.b - v.b) <= 1 AND u.rk <> v.rk AND v.n >= u.n * {ratio}), r(s, v) AS (SELECT rk, rk FROM c UNION SELECT r.s, ln.v FROM r JOIN ln ON ln.u = r.v), own AS (SELECT v, min(s) AS s FROM r GROUP BY v), seeds AS (SELECT s FROM own WHERE s = v),
    cl AS (SELECT r.s, r.v FROM r JOIN seeds USING (s)), big AS (SELECT s, row_number() OVER (ORDER BY s) AS cluster FROM (SELECT s FROM cl GROUP BY s HAVING count(*) > {cells}))"""


@query("patchwork_clusters", f"WITH RECURSIVE {PW.format(pts=2, ratio=0.9, cells=2)} SELECT cluster, a || ',' || b AS cell FROM cl JOIN big USING (s) JOIN c ON c.rk = cl.v")
def patchwork_clusters(spark, sf_dir):
    t = grid.ceil_cells(read(spark, sf_dir, "part"), {"p_size": 5, "p_retailprice": 10})
    return density.density_clusters(grid.cell_counts(t), 2, 0.9, 2, 2).select("cluster", grid.cell_name().alias("cell"))


@query("patchwork_predict", f"WITH RECURSIVE {PW.format(pts=2, ratio=0.9, cells=2)}, f AS (SELECT c.a, c.b, min(cluster) AS cluster FROM cl JOIN big USING (s) JOIN c ON c.rk = cl.v GROUP BY 1, 2) SELECT p_partkey, coalesce(cluster, -1) AS cluster FROM part LEFT JOIN f ON f.a = ceil(p_size / 5.0) AND f.b = ceil(p_retailprice / 10.0)")
def patchwork_predict(spark, sf_dir):
    return density.density_grid(read(spark, sf_dir, "part"), {"p_size": 5, "p_retailprice": 10}, 0.9, 2, 2).select("p_partkey", "cluster")


@query("merging_cells_areas", f"WITH RECURSIVE {PW.format(pts=1, ratio=0, cells=0)}, f AS (SELECT c.a, c.b, min(cluster) AS cluster FROM cl JOIN big USING (s) JOIN c ON c.rk = cl.v GROUP BY 1, 2) SELECT p_partkey AS rid, CAST(cluster AS INT) AS area_id FROM part LEFT JOIN f ON f.a = ceil(p_size / 5.0) AND f.b = ceil(p_retailprice / 10.0)")
def merging_cells_areas(spark, sf_dir):
    return areas.discover("MERGINGCELLS", read(spark, sf_dir, "part"), "p_partkey", eps={"p_size": 5, "p_retailprice": 10})


@query("cell_areas", "WITH c AS (SELECT p_partkey, CAST(trunc((p_size - (SELECT min(p_size) FROM part)) / 5.0) AS BIGINT) AS x, CAST(trunc((p_retailprice - (SELECT min(p_retailprice) FROM part)) / 10) AS BIGINT) AS y FROM part) SELECT p_partkey AS rid, CAST(dense_rank() OVER (ORDER BY x, y) AS INT) AS area_id FROM c")
def cell_areas(spark, sf_dir):
    return areas.discover("CELLS", read(spark, sf_dir, "part"), "p_partkey", numeric={"p_size": 5, "p_retailprice": 10})


@query("points_with_areas", "WITH c AS (SELECT p_partkey, p_brand, CAST(trunc((p_size - (SELECT min(p_size) FROM part)) / 5.0) AS BIGINT) AS x, CAST(trunc((p_retailprice - (SELECT min(p_retailprice) FROM part)) / 10) AS BIGINT) AS y FROM part) SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY x, y) AS INT) AS area_id FROM c")
def points_with_areas(spark, sf_dir):
    """Each part with the area of its cell beside its own columns."""
    part = read(spark, sf_dir, "part")
    found = areas.discover("CELLS", part, "p_partkey", numeric={"p_size": 5, "p_retailprice": 10})
    return areas.with_areas(part, found, "p_partkey").select("p_partkey", "p_brand", "area_id")


@query(
    "hotspot_areas",
    f"""WITH RECURSIVE {GI}, h AS (SELECT x, y, t, row_number() OVER (ORDER BY x, y, t) AS i, x + y * nx + t * nx * ny AS cell_id FROM ww, g WHERE x + y * nx + t * nx * ny IN (SELECT cell_id FROM z WHERE z.z > 1.5)),
    ed AS (SELECT a.i AS a, b.i AS b FROM h a JOIN h b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.t - b.t) <= 1), r(i, c) AS (SELECT i, i FROM h UNION SELECT ed.b, r.c FROM r JOIN ed ON ed.a = r.i AND r.c < ed.b), l AS (SELECT cell_id, dense_rank() OVER (ORDER BY c) AS area FROM (SELECT i, min(c) AS c FROM r GROUP BY i) JOIN h USING (i))
    SELECT event_id AS rid, CAST(coalesce(area, 0) AS INT) AS area_id FROM (SELECT event_id, least(CAST(trunc((value - x0) / 25) AS BIGINT), nx - 1) + least(CAST(trunc((k - y0) / 25.0) AS BIGINT), ny - 1) * nx + least((t - t0) // {DAY_US}, nt - 1) * nx * ny AS cell_id FROM ev, g) LEFT JOIN l USING (cell_id)""",
)
def hotspot_areas(spark, sf_dir):
    p, e = _hot(spark, sf_dir)
    ids = hotspot.with_cell(hotspot.usable(events(spark, sf_dir), "event_id", "value", "k", "t"), e).select(F.col("key").alias("event_id"), "cell_id")
    return areas.discover("HOTSPOT", ids, "event_id", attribute=hotspot.dwell(p, e), e=e, threshold=1.5, h=2)


# ---- k-means family ----

CENTRES = [[1.0 if i == j else 0.0 for i in range(64)] for j in range(10)]
NEAR = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT vec_id, v, j.j AS cluster, list_dot_product(v, v) + 1 - 2 * v[j.j + 1] AS dist FROM e, range(10) j(j)), a AS (SELECT vec_id, any_value(v) AS v, arg_min(cluster, dist) AS cluster, min(dist) AS dist FROM d GROUP BY vec_id)"


def vectors(spark, sf_dir):
    return kmeans.points_of(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)


@query("nearest_centroid", f"WITH {NEAR} SELECT vec_id AS id, CAST(cluster AS INT) AS cluster, round(dist, 5) AS dist FROM a")
def nearest_centroid(spark, sf_dir):
    return kmeans.nearest_centroid(vectors(spark, sf_dir), CENTRES).select("id", "cluster", F.round("dist", 5).alias("dist"))


@query("kmeans_one_step", f"WITH {NEAR}, x AS (SELECT cluster, i.i AS pos, avg(v[i.i + 1]) AS m, count(*) AS n FROM a, range(64) i(i) GROUP BY 1, 2) SELECT CAST(cluster AS INT) AS cluster, CAST(pos AS INT) AS pos, round(m, 6) AS m, n FROM x")
def kmeans_one_step(spark, sf_dir):
    means = kmeans.element_means(kmeans.nearest_centroid(vectors(spark, sf_dir), CENTRES))
    return means.select("cluster", F.posexplode("center").alias("pos", "m"), "n").select("cluster", "pos", F.round("m", 6).alias("m"), "n")


@query("model_cost", f"WITH {NEAR} SELECT round(sum(dist), 4) AS cost FROM a")
def model_cost(spark, sf_dir):
    return kmeans.model_cost(vectors(spark, sf_dir), CENTRES).select(F.round("cost", 4).alias("cost"))


#: A Lloyd step in SQL, and ten fixed centres to start from.
STEP = """n{k} AS (SELECT vec_id, v, arg_min(j, d) AS cluster FROM (SELECT e.vec_id, e.v, c.j, list_dot_product(e.v, e.v) - 2 * list_dot_product(e.v, c.c) + list_dot_product(c.c, c.c) AS d FROM e, c{k} c) GROUP BY vec_id, v),
    c{n} AS (SELECT j, list(m ORDER BY pos) AS c FROM (SELECT cluster AS j, i.i AS pos, avg(v[i.i + 1]) AS m FROM n{k}, range(64) i(i) GROUP BY 1, 2) GROUP BY j)"""
START = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c0 AS (SELECT j.j, list_transform(range(64), lambda x: CASE WHEN x = j.j THEN 1.0 ELSE 0.0 END) AS c FROM range(10) j(j))"


@query("kmeans_fixed_start", f"WITH {START}, {STEP.format(k=0, n=1)}, {STEP.format(k=1, n=2)}, {STEP.format(k=2, n=3)} SELECT CAST(j AS INT) AS cluster, CAST(i.i AS INT) AS pos, round(c[i.i + 1], 6) AS m FROM c3, range(64) i(i)")
def kmeans_fixed_start(spark, sf_dir):
    """Three Lloyd steps from fixed centres."""
    centers, _, _ = kmeans.kmeans(vectors(spark, sf_dir), 10, 64, "euclidean", iterations=3, epsilon=0.0, start=CENTRES)
    return kmeans.kmeans_table(spark, centers).select("cluster", F.posexplode("center").alias("pos", "m")).select("cluster", "pos", F.round("m", 6).alias("m"))


@query("kmeans_centers")
def kmeans_centers(spark, sf_dir):
    centers, _, _ = kmeans.kmeans(vectors(spark, sf_dir), 8, 64, "RV", iterations=10)
    return kmeans.kmeans_table(spark, centers)


@query("bisecting_areas")
def bisecting_areas(spark, sf_dir):
    return areas.discover("BISECTING", read(spark, sf_dir, "embeddings"), "vec_id", vec="embedding", dim=64, k=8, name="cosine", iterations=5)


@query("bisecting_tree")
def bisecting_tree(spark, sf_dir):
    nodes, _ = kmeans.bisecting(vectors(spark, sf_dir), 6, 64, "RV", iterations=5)
    return kmeans.nodes_table(spark, nodes)


@query("projection_hash", "SELECT vec_id, round((%s + 7 * 0.5) / 2.0, 6) AS h FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)" % " + ".join(f"v[{i + 1}] * {a!r}" for i, a in enumerate(meanshift.tab_hash(7, 64, 3).tolist())))
def projection_hash(spark, sf_dir):
    h = meanshift.hash_column("v", meanshift.tab_hash(7, 64, 3), 0.5, 2.0, 7)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).select("vec_id", F.round(h, 6).alias("h"))


@query(
    "mslsh_modes",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id AS id, b.v, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v)) AS r FROM e a JOIN e b ON true)
    SELECT id, round(sum(list_sum(v)) / 7, 5) AS total, round(sum(v[1]) / 7, 5) AS first FROM d WHERE r <= 7 GROUP BY id""",
)
def mslsh_modes(spark, sf_dir):
    """One step of mean shift over a single slice: each mode is the mean of the seven nearest points."""
    modes = meanshift.mean_shift_lsh(vectors(spark, sf_dir), 64, k=7, iterations=1, slices=1, label_slices=1, normalise=False)["modes"]
    return modes.select("id", F.round(A.total("mode"), 5).alias("total"), F.round(F.col("mode")[0], 5).alias("first"))


@query("mslsh_areas")
def mslsh_areas(spark, sf_dir):
    return areas.discover("MSLSH", read(spark, sf_dir, "embeddings"), "vec_id", vec="embedding", dim=64, iterations=4, slices=5, epsilon2=0.5, epsilon3=0.5)
