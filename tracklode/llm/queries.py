"""Queries of the operators for training data, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklode.llm import communities, linking, mixture, neighbours, privacy, setjoin, subsequences, tokens
from tracklode.runtime import read

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function and its SQL, where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


USABLE = "u AS (SELECT rid, min(features) AS f FROM point_features WHERE rid IS NOT NULL AND len(features) = 16 AND len(list_filter(features, lambda x: x IS NOT NULL AND isfinite(x))) = 16 GROUP BY rid)"


def _patterns_sql(columns: str, longest: int = 8) -> str:
    """Level by level, each level grown from the frequent patterns of the last; patterns of more than
    `longest` areas would be missing."""
    out = """WITH i AS (SELECT DISTINCT d_0 AS d, x.time AS t, x.area_id AS a FROM (SELECT d_0, unnest(items) AS x FROM traj_items WHERE d_0 IS NOT NULL) WHERE x.time >= 0 AND x.area_id > 0),
    nd AS (SELECT greatest(1, ceil(0.08 * count(DISTINCT d_0) - 1e-9)) AS need FROM traj_items), f1 AS (SELECT a FROM i, nd GROUP BY a, need HAVING count(DISTINCT d) >= need), j AS (SELECT d, t, a FROM i SEMI JOIN f1 USING (a)), g1 AS (SELECT CAST(a AS VARCHAR) AS p, d, t AS last FROM j)"""
    for k in range(2, longest + 1):
        out += f""", c{k} AS (SELECT DISTINCT g.p || ',' || j.a AS p, g.d, j.t AS last FROM g{k - 1} g JOIN j ON j.d = g.d AND j.t > g.last AND j.t - g.last <= 800),
    f{k} AS (SELECT p, count(DISTINCT d) AS support FROM c{k}, nd GROUP BY p, need HAVING count(DISTINCT d) >= need), g{k} AS (SELECT c.* FROM c{k} c SEMI JOIN f{k} USING (p))"""
    return out + " " + " UNION ALL ".join(f"SELECT {columns} FROM f{k}" for k in range(2, longest + 1))


GROUPS = """WITH RECURSIVE e AS (SELECT DISTINCT rid_a AS a, rid_b AS b FROM match_pairs WHERE rid_a IS NOT NULL AND rid_b IS NOT NULL),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    v AS (SELECT rid_a AS rid FROM match_pairs WHERE rid_a IS NOT NULL UNION SELECT rid_b FROM match_pairs WHERE rid_b IS NOT NULL),
    r(rid, g) AS (SELECT rid, rid FROM v UNION SELECT u.b, r.g FROM r JOIN u ON u.a = r.rid AND r.g < u.b)
    SELECT rid, min(g) AS group_rid FROM r GROUP BY rid"""


@query("p4_found", GROUPS)
def p4_found(spark, sf_dir):
    return linking.group_ids(read(spark, sf_dir, "match_pairs"))


@query("p4_decomposed", GROUPS)
def p4_decomposed(spark, sf_dir):
    """p4_found by decomposition down to the last edge, without the finish in one task."""
    return linking.group_ids(read(spark, sf_dir, "match_pairs"), finish_edges=0)


@query("p7_ids")
def p7_ids(spark, sf_dir):
    return tokens.encode(read(spark, sf_dir, "documents"))


@query(
    "p3_found",
    f"""WITH {USABLE}, p AS (SELECT a.rid AS a, b.rid AS b, list_distance(a.f, b.f) AS d FROM u a JOIN u b ON a.rid <> b.rid AND abs(a.f[1] - b.f[1]) <= 2.501), n AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p WHERE d <= 2.5)
    SELECT DISTINCT least(a, b) AS rid_a, greatest(a, b) AS rid_b FROM n WHERE r <= 5""",
)
def p3_found(spark, sf_dir):
    return neighbours.neighbour_pairs(read(spark, sf_dir, "point_features"))


@query(
    "p3_recall",
    f"""WITH {USABLE}, q AS (SELECT rid, f FROM u WHERE CAST(split_part(rid, ',', 2) AS BIGINT) % 50 = 0), p AS (SELECT a.rid AS a, count(*) AS n FROM q a JOIN u b ON a.rid <> b.rid AND list_distance(a.f, b.f) <= 2.5 GROUP BY a.rid)
    SELECT (SELECT count(*) FROM q) AS n_queries, (SELECT CAST(coalesce(sum(least(n, 5)), 0) AS BIGINT) FROM p) AS n_true, true AS reached""",
)
def p3_recall(spark, sf_dir):
    """Second codes forced on every value of more than 64 vectors: the neighbours of a stated query set
    (every tick divisible by 50) among all records, and whether at least 0.97 of them are found."""
    asked = F.split("rid", ",")[1].cast("bigint") % 50 == 0
    r = neighbours.measured_recall(read(spark, sf_dir, "point_features"), asked, heavy=64, leaf=32)
    return r.select("n_queries", "n_true", (F.col("n_found") >= 0.97 * F.col("n_true")).alias("reached"))


@query("p2_found", _patterns_sql("p AS pattern"))
def p2_found(spark, sf_dir):
    return subsequences.frequent_patterns(read(spark, sf_dir, "traj_items")).select("pattern")


@query("p2_supports", _patterns_sql("p AS pattern, support"))
def p2_supports(spark, sf_dir):
    """Every frequent pattern with the number of trajectories that support it."""
    return subsequences.frequent_patterns(read(spark, sf_dir, "traj_items"))


SETS = """s AS (SELECT rid, side, min(list_sort(list_distinct(list_filter(features, lambda x: x IS NOT NULL)))) AS f FROM (SELECT rid, features, 0 AS side FROM set_features UNION ALL SELECT rid, features, 1 FROM area_sets) WHERE rid IS NOT NULL AND len(list_filter(features, lambda x: x IS NOT NULL)) > 0 GROUP BY rid, side),
    t AS (SELECT rid, side, len(f) AS n, unnest(f) AS x FROM s), c AS (SELECT a.rid AS ra, b.rid AS rb, any_value(a.side) + any_value(b.side) AS sides, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.rid < b.rid AND a.n >= 0.6 * b.n - 0.001 AND b.n >= 0.6 * a.n - 0.001 GROUP BY 1, 2)"""


@query("p6_found", f"WITH {SETS} SELECT ra AS rid_a, rb AS rid_b FROM c WHERE c / (na + nb - c) >= 0.6 AND sides < 2")
def p6_found(spark, sf_dir):
    return setjoin.similar_pairs(read(spark, sf_dir, "set_features"), read(spark, sf_dir, "area_sets"))


@query(
    "p6_links",
    f"""WITH {SETS}, g AS (SELECT f, min(rid) AS class_rid, count(*) AS n_class FROM s GROUP BY f), m AS (SELECT s.rid, g.class_rid, g.n_class FROM s JOIN g ON s.f = g.f),
    l AS (SELECT class_rid, count(DISTINCT o) AS n_links FROM (SELECT x.class_rid, y.class_rid AS o FROM c JOIN m x ON x.rid = ra JOIN m y ON y.rid = rb WHERE c / (na + nb - c) >= 0.6 UNION ALL SELECT y.class_rid, x.class_rid FROM c JOIN m x ON x.rid = ra JOIN m y ON y.rid = rb WHERE c / (na + nb - c) >= 0.6) WHERE class_rid <> o GROUP BY 1)
    SELECT m.rid, m.class_rid, m.n_class, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN l USING (class_rid)""",
)
def p6_links(spark, sf_dir):
    """One row per record: its group of equal sets and how many other sets are similar to it."""
    return setjoin.similarity_links(read(spark, sf_dir, "set_features"), read(spark, sf_dir, "area_sets"))


CLUSTERS = f"""{USABLE}, e AS (SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.rid <> b.rid AND abs(a.f[1] - b.f[1]) <= 1.001 AND list_distance(a.f, b.f) <= 1.0),
    r(rid, g) AS (SELECT rid, rid FROM u UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.rid AND r.g < e.b), c AS (SELECT rid, min(g) AS g FROM r GROUP BY rid)"""


@query(
    "p1_found",
    f"""WITH RECURSIVE {CLUSTERS}
    SELECT rid, g AS cluster_rid FROM c WHERE g IN (SELECT g FROM c GROUP BY g HAVING count(*) >= 8)""",
)
def p1_found(spark, sf_dir):
    return communities.cluster_members(read(spark, sf_dir, "point_features"))


@query("p1_clusters")
def p1_clusters(spark, sf_dir):
    """Each cluster with its size and most typical members."""
    return communities.cluster_summary(read(spark, sf_dir, "point_features"))


@query(
    "p1_profiles",
    f"""WITH RECURSIVE {CLUSTERS} SELECT c.g AS cluster_rid, count(*) AS n_rids, least(5, count(DISTINCT u.f)) AS n_typical, true AS inside FROM c JOIN u USING (rid) GROUP BY c.g HAVING count(*) >= 8""",
)
def p1_profiles(spark, sf_dir):
    """Sizes of the clusters, how many typical members each is described by (one a distinct vector), and
    whether all of these are members of it."""
    points = read(spark, sf_dir, "point_features")
    found = communities.cluster_summary(points)
    shown = found.select("cluster_rid", "n_rids", F.size("typical").cast("bigint").alias("n_typical"), F.explode("typical").alias("rid"))
    member = communities.cluster_members(points).select("rid", F.col("cluster_rid").alias("of"))
    return shown.join(member, "rid", "left").groupBy("cluster_rid", "n_rids", "n_typical").agg(F.coalesce(F.min(F.col("of") == F.col("cluster_rid")), F.lit(False)).alias("inside"))


@query("p8_mixture")
def p8_mixture(spark, sf_dir):
    """Every use of a document in the mixture of source_targets."""
    return mixture.mixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "source_targets"))


@query("p8_shares")
def p8_shares(spark, sf_dir):
    """Target and actual share of each source."""
    return mixture.shares(read(spark, sf_dir, "documents"), read(spark, sf_dir, "source_targets"))


@query(
    "p8_seats",
    """WITH q AS (SELECT source, target_share / (2 * s.s + 1) AS quotient FROM source_targets, range(2000) s(s) WHERE target_share > 0)
    SELECT source, count(*) AS n_seats FROM (SELECT source FROM q ORDER BY quotient DESC, source LIMIT 2000) GROUP BY source""",
)
def p8_seats(spark, sf_dir):
    """2,000 blocks dealt to the sources by highest quotients (a top-k of quotients)."""
    goal = {r["source"]: r["target_share"] for r in read(spark, sf_dir, "source_targets").collect()}  # one row a source
    return spark.createDataFrame([(s,) for s in mixture.apportion(goal, 2000)], "source string").groupBy("source").agg(F.count("*").alias("n_seats"))


@query("p8_reached", "SELECT source, target_share, max_repeat, true AS reached, true AS within FROM source_targets")
def p8_reached(spark, sf_dir):
    """Whether each source's tokens in the mixture differ from its target by two blocks and two documents
    at most, and no document is used more than max_repeat times."""
    targets = read(spark, sf_dir, "source_targets")
    used = mixture.mixture(read(spark, sf_dir, "documents"), targets)
    per = used.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"), F.max("n_tokens").alias("d"))
    got = per.groupBy("source").agg(F.sum("t").alias("t"), F.max("c").alias("c"), F.max("d").alias("d"))
    total = got.agg(F.sum("t").alias("total"))
    near = F.abs(F.col("t") - F.col("target_share") * F.col("total")) <= 2 * F.col("total") / mixture.BLOCKS + 2 * F.col("d")
    rows = targets.join(got, "source", "left").crossJoin(F.broadcast(total))  # the total is one row
    return rows.select("source", "target_share", "max_repeat", F.coalesce(near, F.lit(False)).alias("reached"), (F.coalesce("c", F.lit(0)) <= F.col("max_repeat")).alias("within"))


@query("p8_all_tokens", "SELECT source, target_share, max_repeat, true AS within FROM source_targets")
def p8_all_tokens(spark, sf_dir):
    """A mixture as large as the whole corpus: sources that run out stop at max_repeat copies."""
    docs, targets = read(spark, sf_dir, "documents"), read(spark, sf_dir, "source_targets")
    whole = tokens.with_token_counts(docs, ["doc_id"]).agg(F.sum("n_tokens")).head()[0]
    got = mixture.shares(docs, targets, total_tokens=whole).select("source", "n_uses", "most_copies")
    return targets.join(got, "source").select("source", "target_share", "max_repeat", ((F.col("most_copies") <= F.col("max_repeat")) & (F.col("n_uses") > 0)).alias("within"))


@query("p9_found")
def p9_found(spark, sf_dir):
    return privacy.found(read(spark, sf_dir, "documents"), read(spark, sf_dir, "name_parts"))


@query("p9_redacted")
def p9_redacted(spark, sf_dir):
    """Each text with typed placeholders; the key of this query is public, so only for show."""
    return privacy.redacted(read(spark, sf_dir, "documents"), read(spark, sf_dir, "name_parts"), key="p9_redacted")


@query("p9_redaction_check", "SELECT count(*) AS n_documents, count(*) FILTER (WHERE text IS NULL) AS n_null, CAST(0 AS BIGINT) AS n_left FROM documents")
def p9_redaction_check(spark, sf_dir):
    """Redacted texts, null ones among them, and how many mail addresses, phone and identity numbers that
    were found in a text still stand in it."""
    docs, names = read(spark, sf_dir, "documents"), read(spark, sf_dir, "name_parts")
    red = privacy.redacted(docs, names, key="p9_redaction_check").select("doc_id", F.regexp_replace("text", "[ \t\r\n]+", " ").alias("flat"))
    numbers = privacy.found(docs, names).where("kind IN ('EMAIL', 'PHONE', 'IDNUM')").groupBy("doc_id").agg(F.collect_set("surface").alias("s"))
    left = F.size(F.filter("s", lambda x: F.col("flat").contains(x)))
    return red.join(numbers, "doc_id", "left").agg(F.count("*").alias("n_documents"), F.count_if(F.col("flat").isNull()).alias("n_null"), F.coalesce(F.sum(F.when(F.col("s").isNotNull(), left)), F.lit(0)).cast("bigint").alias("n_left"))
