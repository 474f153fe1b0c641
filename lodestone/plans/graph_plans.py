"""Relationships, graphs, integrity, changes and analytics over the star schema and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import FALLBACK_RULE, ROLE_RULES
from ..operators import analytics as A
from ..operators import changes as C
from ..operators import graph as G
from ..operators import integrity as I
from ..operators import relations as N
from .base import Plans, quoted_list

P = Plans()
_EDGE = "regexp_replace(lower(concat_ws('_', type, source_type, source_id, target_type, target_id)), '[^a-z0-9]+', '-', 'g')"


@P.add(f"""SELECT *, substr({_EDGE}, 1, 60) || '-' || substr(sha1({_EDGE}), 1, 6) AS id FROM (
 SELECT 'belongs_to' AS type, 'nation' AS source_type, CAST(n_nationkey AS VARCHAR) AS source_id, 'region' AS target_type, CAST(n_regionkey AS VARCHAR) AS target_id FROM nation
 UNION ALL SELECT 'appears_in', 'supplier', CAST(s_suppkey AS VARCHAR), 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier)""")
def relationship_edges(t):
    """Edges with ids from two generators."""
    a = N.edges(t("nation"), "belongs_to", "nation", F.col("n_nationkey"), "region", F.col("n_regionkey"))
    return a.unionByName(N.edges(t("supplier"), "appears_in", "supplier", F.col("s_suppkey"), "nation", F.col("s_nationkey")))


@P.add("""WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2""")
def cooccurrence_pairs(t):
    """Parts that stand in one order."""
    return N.cooccurrence(t("lineitem"), "l_orderkey", "l_partkey")


ROLES = tuple(dict.fromkeys(r for rule in ROLE_RULES for r in rule[:2]))
_ANCHORS = f"SELECT s_nationkey AS grp, s_suppkey AS anchor_id, list_extract({quoted_list(ROLES)}, CAST(s_suppkey % {len(ROLES)} + 1 AS INT)) AS role, (s_suppkey % 11) / 10.0 AS confidence FROM supplier"
_RULES = ", ".join(str(r[:5]) for r in ROLE_RULES)


@P.add(f"""WITH an AS ({_ANCHORS}), ru(sr, tr, type, direction, w) AS (VALUES {_RULES}),
 pr AS (SELECT s.grp, s.role AS source_role, t.role AS target_role, coalesce(ru.type, 'RELATED_TO') AS type, coalesce(direction, 'BIDIRECTIONAL') AS direction, CAST(coalesce(w, 0.3) AS DOUBLE) AS w, ru.w IS NOT NULL AS hit, CAST(s.confidence AS DOUBLE) AS a, CAST(t.confidence AS DOUBLE) AS b
  FROM an s JOIN an t ON s.grp = t.grp AND s.anchor_id <> t.anchor_id LEFT JOIN ru ON ru.sr = s.role AND ru.tr = t.role)
 SELECT grp, source_role, a AS source_confidence, target_role, b AS target_confidence, type, direction, confidence, count(*) AS n_edges FROM (SELECT grp, source_role, target_role, a, b, type, direction, round(least(1.0, greatest(0.0, (CASE WHEN hit THEN 4 ELSE 1 END + CASE WHEN (a + b) / 2 >= 0.5 THEN 3 ELSE 0 END + 3) / 10 * w * (0.5 + 0.5 * (a + b) / 2))) + 1e-9, 4) AS confidence FROM pr) WHERE confidence >= 0.1 GROUP BY ALL""")
def rule_relationships(t):
    """Role rules among the suppliers of a nation, by classes of suppliers; the SQL forms all pairs and counts them."""
    roles = F.array(*[F.lit(r) for r in ROLES])
    s = t("supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("anchor_id"), F.element_at(roles, (F.col("s_suppkey") % len(ROLES) + 1).cast("int")).alias("role"), ((F.col("s_suppkey") % 11) / 10.0).alias("confidence"))
    rules = s.sparkSession.createDataFrame([r[:5] for r in ROLE_RULES], "source_role string, target_role string, type string, direction string, weight double")
    return N.rule_relationships(s, rules, "grp", FALLBACK_RULE)


@P.add("SELECT l_suppkey, l_partkey, max(l_discount) AS confidence, count(*) AS n_merged FROM lineitem GROUP BY 1, 2")
def edge_dedupe(t):
    return N.best_edges(t("lineitem").select("l_suppkey", "l_partkey", F.col("l_discount").alias("confidence")), ["l_suppkey", "l_partkey"], "confidence")


@P.add("SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 4) AS avg_confidence, round(min(l_discount), 4) AS min_confidence, round(max(l_discount), 4) AS max_confidence FROM lineitem GROUP BY 1")
def graph_stats(t):
    return A.by_confidence(t("lineitem"), "l_returnflag", "l_discount")


@P.add("SELECT DISTINCT p_brand, p_partkey FROM part WHERE p_brand IS NOT NULL AND p_partkey IS NOT NULL")
def inverted_indexes(t):
    return A.inverted_index(t("part"), "p_brand", "p_partkey")


_COPURCHASE = "SELECT a AS source, b AS target FROM (WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2) WHERE n >= 2"


def copurchase(t):
    return N.cooccurrence(t("lineitem"), "l_orderkey", "l_partkey").where("n >= 2").select(F.col("a").alias("source"), F.col("b").alias("target"))


def parts(t):
    return t("part").select(F.col("p_partkey").alias("node"))


@P.add(f"""WITH e AS ({_COPURCHASE}), d AS (SELECT p_partkey AS node, count(k) AS degree FROM part LEFT JOIN (SELECT source AS k FROM e UNION ALL SELECT target FROM e) ON k = p_partkey GROUP BY 1)
 SELECT node, degree, degree > (SELECT avg(degree) + stddev_pop(degree) FROM d) AS is_hub FROM d""")
def hub_nodes(t):
    return A.degrees(copurchase(t), parts(t))


@P.add(f"""WITH e AS ({_COPURCHASE}), n AS (SELECT count(*) AS n FROM part), o AS (SELECT count(*) AS o FROM part WHERE p_partkey NOT IN (SELECT source FROM e UNION SELECT target FROM e)), m AS (SELECT count(*) AS m FROM e)
 SELECT n AS n_nodes, m AS n_edges, o AS n_orphans, round(m / (n * (n - 1)), 4) AS density, round(o / n, 4) AS orphan_ratio FROM n, m, o""")
def learning_analytics(t):
    return A.graph_summary(copurchase(t), parts(t))


@P.add("""SELECT c_custkey, round((CASE WHEN c_name IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 2 ELSE 0 END + CASE WHEN n >= 10 THEN 4 ELSE 0 END + CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END) / 10, 4) AS completeness
 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def completeness_score(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    checks = {"name": (F.col("c_name").isNotNull(), 3), "funds": (F.col("c_acctbal") > 0, 2), "orders": (F.col("n") >= 10, 4), "segment": (F.col("c_mktsegment") == "MACHINERY", 1)}
    return t("customer").join(n, "c_custkey", "left").select("c_custkey", A.completeness(checks).alias("completeness"))


@P.add("""SELECT l_suppkey, arg_max(q, {'w': w, 'q': q}) AS mode, max(w) AS weight FROM (SELECT l_suppkey, l_returnflag AS q, count(*) AS w FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def mode_weighted(t):
    return A.mode_weighted(t("lineitem"), "l_suppkey", "l_returnflag", F.lit(1)).select("l_suppkey", "mode", "weight")


@P.add("SELECT n_regionkey, c_custkey, CAST(nth AS INT) AS nth FROM (SELECT n_regionkey, c_custkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_acctbal DESC, c_custkey) AS nth FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE nth <= 5")
def top_n_per_group(t):
    """The five customers with the largest balance of each region: five of each task first, then five of those."""
    n, c = t("nation"), t("customer")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select("n_regionkey", "c_custkey", "c_acctbal")
    from pyspark.sql import Window

    w = lambda *k: Window.partitionBy(*k).orderBy(F.desc("c_acctbal"), "c_custkey")
    some = rows.withColumn("salt", F.pmod(F.xxhash64("c_custkey"), F.lit(64))).withColumn("nth", F.row_number().over(w("n_regionkey", "salt"))).where("nth <= 5")
    return some.withColumn("nth", F.row_number().over(w("n_regionkey"))).where("nth <= 5").select("n_regionkey", "c_custkey", "nth")


_TREE = """WITH e AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem)"""


def tree(t):
    """region -> nation -> supplier -> part, as one edge table."""
    e = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"))
    s = e(t("supplier"), "n", "s_nationkey", "s", "s_suppkey")
    p = e(t("lineitem").select("l_suppkey", "l_partkey").distinct(), "s", "l_suppkey", "p", "l_partkey")
    return e(t("nation"), "r", "n_regionkey", "n", "n_nationkey").unionByName(s).unionByName(p)


def below(e):
    return G.closure(e).groupBy("ancestor").agg(F.count("*").alias("n_below"), F.min("node").alias("first_below"))


@P.add(_TREE.replace("WITH", "WITH RECURSIVE", 1) + ", c AS (SELECT source AS ancestor, target AS node FROM e UNION SELECT c.ancestor, e.target FROM c JOIN e ON c.node = e.source) SELECT ancestor, count(*) AS n_below, min(node) AS first_below FROM c GROUP BY 1")
def transitive_prereqs(t):
    """How many nodes lie below each node, through any path."""
    return below(tree(t))


def depths(e):
    return G.levels(e, e.select(F.col("source").alias("node")).union(e.select("target")))


@P.add(_TREE.replace("WITH", "WITH RECURSIVE", 1) + ", c AS (SELECT DISTINCT source AS node, 0 AS level FROM e WHERE source NOT IN (SELECT target FROM e) UNION SELECT e.target, c.level + 1 FROM c JOIN e ON c.node = e.source) SELECT node, max(level) AS level FROM c GROUP BY 1")
def max_depth(t):
    """The longest path from a root to each node."""
    return depths(tree(t))


@P.add("SELECT 's' || s_suppkey AS node, 'r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey || '/n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region")
def hierarchy_path(t):
    up = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("node"), (F.concat(F.lit(b), y) if b else F.lit(None).cast("string")).alias("parent"))
    rows = up(t("supplier"), "s", "s_suppkey", "n", "s_nationkey").unionByName(up(t("nation"), "n", "n_nationkey", "r", "n_regionkey")).unionByName(up(t("region"), "r", "r_regionkey", "", ""))
    return G.paths(rows).select("node", F.array_join("path", "/").alias("path"))


def bought(t):
    """Customer -> part, through all orders."""
    o, l = t("orders"), t("lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))


@P.add("""WITH RECURSIVE m AS (SELECT DISTINCT 'c' || o_custkey AS a, 'p' || l_partkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), e AS (SELECT a AS x, b AS y FROM m UNION ALL SELECT b, a FROM m),
 c(node, component) USING KEY (node) AS (SELECT x, min(least(x, y)) FROM e GROUP BY x UNION SELECT e.y, min(c.component) FROM c JOIN e ON c.node = e.x JOIN recurring.c AS r ON r.node = e.y WHERE c.component < r.component GROUP BY e.y) SELECT node, component FROM c""")
def components(t):
    """Customers and parts linked through all orders."""
    return G.components(bought(t))


def above_changed(e):
    changed = e.sparkSession.createDataFrame([("p1",), ("p2",), ("s3",)], "node string")
    return G.affected(e, changed)


@P.add(_TREE.replace("WITH", "WITH RECURSIVE", 1) + ", c AS (SELECT DISTINCT source AS node FROM e WHERE target IN ('p1', 'p2', 's3') UNION SELECT e.source FROM c JOIN e ON c.node = e.target) SELECT node FROM c WHERE node NOT IN ('p1', 'p2', 's3')")
def affected_closure(t):
    """What depends on three changed nodes."""
    return above_changed(tree(t))


_SNAP = "SELECT strftime(ts, '%Y-%m-%d') AS build_id, 'u' || user_id AS artifact, md5(CAST(count(*) // 3 AS VARCHAR)) AS fingerprint FROM events GROUP BY 1, 2"


def snapshots(t):
    """Builds of a day each: a user's fingerprint is that of a third of the number of their events."""
    return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("build_id"), F.concat(F.lit("u"), "user_id").alias("artifact")).agg(F.md5(F.floor(F.count("*") / 3).cast("string")).alias("fingerprint"))


def _side(build):
    return f"(SELECT artifact, fingerprint FROM s WHERE build_id = '{build}')"


_DIFF = f"""WITH s AS ({_SNAP}) SELECT coalesce(a.artifact, b.artifact) AS artifact, CASE WHEN a.artifact IS NULL THEN 'added' WHEN b.artifact IS NULL THEN 'removed' WHEN a.fingerprint <> b.fingerprint THEN 'modified' ELSE 'unchanged' END AS change
 FROM {_side('2024-01-10')} a FULL JOIN {_side('2024-01-11')} b ON a.artifact = b.artifact"""


def two_days(t):
    s = snapshots(t)
    return C.diff(s.where("build_id = '2024-01-10'"), s.where("build_id = '2024-01-11'"))


@P.add(_DIFF)
def snapshot_diff(t):
    return two_days(t)


@P.add(f"""WITH s AS ({_SNAP}), m AS (SELECT *, coalesce(CAST(fingerprint <> lag(fingerprint) OVER w AS INT), 0) AS moved FROM s WINDOW w AS (PARTITION BY artifact ORDER BY build_id)),
 r AS (SELECT artifact, sum(moved) OVER (PARTITION BY artifact ORDER BY build_id) AS run FROM m), l AS (SELECT artifact, run, count(*) AS length FROM r GROUP BY 1, 2)
 SELECT artifact, CAST(sum(length) AS BIGINT) AS n_builds, count(*) - 1 AS n_changes, max(length) AS longest FROM l GROUP BY 1""")
def churn_streak(t):
    return C.streaks(snapshots(t))


@P.add(f"""WITH s AS ({_SNAP}), m AS (SELECT *, coalesce(CAST(fingerprint <> lag(fingerprint) OVER (PARTITION BY artifact ORDER BY build_id) AS INT), 0) AS moved FROM s) SELECT build_id, count(*) AS n_artifacts, CAST(sum(moved) AS BIGINT) AS n_moved FROM m GROUP BY 1""")
def churn_by_build(t):
    return C.churn(snapshots(t))


@P.add(f"""WITH d AS ({_DIFF}), dirty AS (SELECT artifact, 'source_' || change AS reason FROM d WHERE change IN ('added', 'modified')),
 e AS (SELECT DISTINCT 'g' || (user_id % 5) AS source, 'u' || user_id AS target FROM events), b AS (SELECT DISTINCT source AS artifact FROM e JOIN dirty ON target = artifact)
 SELECT artifact, reason FROM dirty UNION ALL SELECT artifact, 'dependency_changed' FROM b WHERE artifact NOT IN (SELECT artifact FROM dirty)""")
def rebuild_plan(t):
    """Changed users, and the groups that depend on them."""
    changes = two_days(t)
    e = t("events").select(F.concat(F.lit("g"), F.col("user_id") % 5).alias("source"), F.concat(F.lit("u"), "user_id").alias("target")).distinct()
    dirty = changes.where("change in ('added', 'modified')").select(F.col("artifact").alias("node"))
    return C.rebuild_plan(changes, G.affected(e, dirty))


_ISSUES = """SELECT 'orders_status' AS rule, 'WARNING' AS severity, CAST(o_orderkey AS VARCHAR) AS object_id, o_orderstatus AS detail FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
 UNION ALL SELECT 'customer_funds', 'WARNING', CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer WHERE NOT c_acctbal >= 0
 UNION ALL SELECT 'line_twice', 'ERROR', CAST(l_orderkey AS VARCHAR), CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
 UNION ALL SELECT 'label_document', 'ERROR', CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
 UNION ALL SELECT 'customer_one_order', 'WARNING', CAST(c_custkey AS VARCHAR), CAST(count(o_orderkey) AS VARCHAR) FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <> 1"""


def all_rules(t):
    o, c, l = t("orders"), t("customer"), t("lineitem")
    twice = I.issues(l.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1"), "line_twice", "ERROR", F.col("l_orderkey"), F.col("n"))
    return I.all_issues(
        I.out_of_range(o, "o_orderkey", F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus"), "orders_status"),
        I.out_of_range(c, "c_custkey", F.col("c_acctbal") >= 0, F.col("c_mktsegment"), "customer_funds"),
        twice,
        I.broken_reference(t("labels"), "doc_id", "doc_id", t("documents"), "doc_id", "label_document"),
        I.unowned(c, "c_custkey", o, "o_custkey", "customer_one_order"),
    )


@P.add(_ISSUES)
def integrity_issues(t):
    """Five rules as one table of issues."""
    return all_rules(t)


@P.add(f"WITH i AS ({_ISSUES}), n AS (SELECT count(*) AS n FROM orders) SELECT severity, count(*) AS n_issues, round(1 - count(DISTINCT object_id) / (SELECT n FROM n), 4) AS score FROM i GROUP BY 1")
def quality_issues(t):
    return I.quality_score(all_rules(t), t("orders").count())


@P.add("SELECT 'n_' || n_nationkey AS object_id, 'no_reverse:' || n_regionkey AS detail FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT 'n_' || n_nationkey, 'no_forward:' || n_regionkey FROM nation WHERE n_nationkey % 7 = 1")
def reverse_mismatch(t):
    """Forward and backward links that do not agree."""
    n = t("nation").select(F.concat(F.lit("n_"), "n_nationkey").alias("a"), F.col("n_regionkey").alias("b"), (F.col("n_nationkey") % 7).alias("m"))
    return I.reverse_mismatch(n.where("m <> 1"), n.where("m <> 0"), ["a", "b"], "links").select("object_id", "detail")


@P.add("SELECT md5(text) AS key, CAST(count(*) AS VARCHAR) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(t):
    d = t("documents").select(F.md5("text").alias("key"))
    return I.duplicate_id(d, "key", "copies").select(F.col("object_id").alias("key"), F.col("detail").alias("n"))
