"""Integrity rules, cycles, paths, merged lines and persisted tables over the star schema and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import integrity as I
from ..operators import lookup as L
from ..operators import ordered as O
from ..operators import reach as R
from ..sources import builds as B
from ..sources import lines as S
from ..sources.shared import kept, session_folder
from .base import Plans
from .graph_plans import _SNAP, _TREE, snapshots, tree

P = Plans()
_RECURSIVE = _TREE.replace("WITH", "WITH RECURSIVE", 1)

#: A tree with faults: dangling and circular parents, spans beyond the parent's, repeated places, ids and numbers that do not fit.
_NODES = """nodes AS (SELECT 'world' AS node, NULL AS parent, 0 AS level, 0 AS span_start, 100000 AS span_end, 0 AS ord, md5('world') AS stored_id, '0' AS number
 UNION ALL SELECT 'r' || r_regionkey, 'world', 1, r_regionkey * 1000, r_regionkey * 1000 + 999, r_regionkey, md5('r' || r_regionkey), CAST(r_regionkey AS VARCHAR) FROM region
 UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 11 = 5 THEN 'missing' WHEN n_nationkey = 8 THEN 'n9' WHEN n_nationkey = 9 THEN 'n8' ELSE 'r' || n_regionkey END, CASE WHEN n_nationkey % 13 = 3 THEN 3 ELSE 2 END,
  n_regionkey * 1000 + n_nationkey * 10, n_regionkey * 1000 + n_nationkey * 10 + CASE WHEN n_nationkey % 7 = 2 THEN 5000 ELSE 9 END, n_nationkey // 6, md5('n' || n_nationkey || CASE WHEN n_nationkey % 9 = 4 THEN 'x' ELSE '' END), n_regionkey || CASE WHEN n_nationkey % 8 = 1 THEN '-' ELSE '.' END || n_nationkey FROM nation
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 3, s_suppkey % 5000, s_suppkey % 5000, s_suppkey, md5('s' || s_suppkey), 'S' || s_suppkey FROM supplier)"""


def nodes(t):
    spark = t("nation").sparkSession
    schema = "node string, parent string, level int, span_start int, span_end int, ord int, stored_id string, number string"
    world = spark.createDataFrame([("world", None, 0, 0, 100_000, 0, "7d793037a0760186574b0282f2f435e7", "0")], schema)
    rk, nk, nr, sk = F.col("r_regionkey"), F.col("n_nationkey"), F.col("n_regionkey"), F.col("s_suppkey")
    named = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    r = t("region").select(named("r", rk), F.lit("world"), F.lit(1), rk * 1000, rk * 1000 + 999, rk, F.md5(named("r", rk)), rk.cast("string"))
    parent = F.when(nk % 11 == 5, "missing").when(nk == 8, "n9").when(nk == 9, "n8").otherwise(named("r", nr))
    start = nr * 1000 + nk * 10
    n = t("nation").select(named("n", nk), parent, F.when(nk % 13 == 3, 3).otherwise(2), start, start + F.when(nk % 7 == 2, 5000).otherwise(9), F.floor(nk / 6).cast("int"), F.md5(F.concat(named("n", nk), F.when(nk % 9 == 4, "x").otherwise(""))), F.concat(nr.cast("string"), F.when(nk % 8 == 1, "-").otherwise("."), nk.cast("string")))
    s = t("supplier").select(named("s", sk), named("n", F.col("s_nationkey")), F.lit(3), (sk % 5000).cast("int"), (sk % 5000).cast("int"), sk.cast("int"), F.md5(named("s", sk)), named("S", sk))
    return world.union(r).union(n).union(s)


@P.add(f"""WITH RECURSIVE {_NODES}, below AS (SELECT 'world' AS node UNION SELECT c.node FROM below JOIN nodes c ON c.parent = below.node), up AS (SELECT node, parent AS above FROM nodes WHERE parent IS NOT NULL UNION SELECT up.node, n.parent FROM up JOIN nodes n ON n.node = up.above WHERE n.parent IS NOT NULL)
 SELECT 'S1' AS rule, node AS object_id, parent AS detail FROM nodes WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM nodes) UNION ALL SELECT 'S1_cycle', node, 'cycle' FROM up WHERE node = above
 UNION ALL SELECT 'S3', c.node, c.span_start || '-' || c.span_end FROM nodes c JOIN nodes p ON c.parent = p.node WHERE c.span_start < p.span_start OR c.span_end > p.span_end
 UNION ALL SELECT 'S4', node, parent FROM nodes WHERE node NOT IN (SELECT node FROM below) UNION ALL SELECT 'O1', parent, ord || ' x' || count(*) FROM nodes WHERE parent IS NOT NULL GROUP BY parent, ord HAVING count(*) > 1
 UNION ALL SELECT 'I1', node, stored_id FROM nodes WHERE stored_id <> md5(node) UNION ALL SELECT 'I2', node, number FROM nodes WHERE NOT regexp_matches(number, '^([0-9]+(\\.[0-9]+)*|S[0-9]+)$')
 UNION ALL SELECT 'B1', c.node, CAST(c.level AS VARCHAR) FROM nodes c JOIN nodes p ON c.parent = p.node WHERE c.level <> p.level + 1""")
def tree_rules(t):
    """Eight invariants of a tree: parents, cycles, spans, reachability, order, ids, numbers and levels."""
    n = kept(nodes(t))
    up = n.where("parent is not null")
    p = n.select(F.col("node").alias("parent"), F.col("level").alias("above"))
    found = I.all_issues(
        I.broken_reference(n, "node", "parent", n, "node", "S1"),
        I.issues(R.strong_components(up.select(F.col("node").alias("source"), F.col("parent").alias("target"))), "S1_cycle", "ERROR", F.col("node"), F.lit("cycle")),
        I.span_outside(n, "S3"),
        I.unreachable(n, "world", "S4"),
        I.duplicate_entry(up, "parent", "ord", "O1"),
        I.not_recomputable(n, "node", F.col("stored_id"), F.md5("node"), "I1"),
        I.shape_differs(n, "node", "number", r"^([0-9]+(\.[0-9]+)*|S[0-9]+)$", "I2"),
        I.issues(n.join(p, "parent").where("level <> above + 1"), "B1", "ERROR", F.col("node"), F.col("level")),
    )
    return found.select("rule", "object_id", "detail")


@P.add(f"""WITH {_NODES}, d AS (SELECT parent, node FROM nodes WHERE parent IS NOT NULL AND ord % 5 <> 1 UNION SELECT node, 'ghost' FROM nodes WHERE ord % 6 = 2), a AS (SELECT parent, node FROM nodes WHERE parent IS NOT NULL)
 SELECT parent AS object_id, 'declared:' || node AS detail FROM (SELECT * FROM d EXCEPT SELECT * FROM a) UNION ALL SELECT parent, 'actual:' || node FROM (SELECT * FROM a EXCEPT SELECT * FROM d)""")
def declared_children(t):
    """Rule O2: declared and actual children."""
    n = kept(nodes(t))
    declared = n.where("parent is not null and ord % 5 <> 1").select("parent", "node").union(n.where("ord % 6 = 2").select(F.col("node"), F.lit("ghost")))
    return I.declared_differs(n, declared, "O2").select("object_id", "detail")


_REFS = "refs AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS ref, CASE WHEN o_orderkey % 89 = 0 THEN 'OTHER' ELSE c_mktsegment END AS kind FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"


@P.add(f"""WITH {_REFS} SELECT 'R2' AS rule, CAST(o_orderkey AS VARCHAR) AS object_id, CAST(ref AS VARCHAR) AS detail FROM refs WHERE ref NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'R3', CAST(o_orderkey AS VARCHAR), kind || '/' || c_mktsegment FROM refs JOIN customer ON ref = c_custkey WHERE kind IS DISTINCT FROM c_mktsegment
 UNION ALL SELECT 'orphan', CAST(c_custkey AS VARCHAR), '0' FROM customer WHERE c_custkey NOT IN (SELECT ref FROM refs)""")
def content_rules(t):
    """References that are broken, whose type differs, and objects that none refers to."""
    o, c = t("orders"), t("customer")
    joined = o.join(c, o.o_custkey == c.c_custkey, "left")
    refs = joined.select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey")).alias("ref"), F.when(F.col("o_orderkey") % 89 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("kind"))
    alone = c.join(refs.select(F.col("ref").alias("c_custkey")), "c_custkey", "left_anti")
    found = I.all_issues(I.broken_reference(refs, "o_orderkey", "ref", c, "c_custkey", "R2"), I.type_differs(refs, "o_orderkey", "ref", "kind", c, "c_custkey", "c_mktsegment", "R3"), I.issues(alone, "orphan", "WARNING", F.col("c_custkey"), F.lit(0)))
    return found.select("rule", "object_id", "detail")


@P.add("""SELECT 'missing_text' AS rule, 'ERROR' AS severity, CAST(doc_id AS VARCHAR) AS object_id, 'text' AS detail FROM documents WHERE text IS NULL OR trim(text, ' ') = ''
 UNION ALL SELECT 'source_vocabulary', 'WARNING', CAST(doc_id AS VARCHAR), coalesce(source, 'null') FROM documents WHERE source IS NULL OR source NOT IN ('web', 'books', 'forum')
 UNION ALL SELECT 'wordy', 'WARNING', CAST(doc_id AS VARCHAR), CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS VARCHAR) FROM documents WHERE len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) > 400
 UNION ALL SELECT 'url_shape', 'ERROR', CAST(page_id AS VARCHAR), url FROM pages WHERE url IS NOT NULL AND NOT regexp_matches(url, '^https://[a-z0-9.-]+/')
 UNION ALL SELECT 'required_lang', 'ERROR', v, 'absent' FROM (VALUES ('en'), ('xx')) r(v) WHERE v NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)
 UNION ALL SELECT 'provenance', 'WARNING', CAST(doc_id AS VARCHAR), CAST(n_chars AS VARCHAR) FROM documents WHERE NOT coalesce(n_chars BETWEEN 10 AND 3000, false)""")
def document_rules(t):
    """Rules on documents and pages: missing fields, vocabularies, word caps, shapes, required values, ranges."""
    d, p = t("documents"), t("pages")
    return I.all_issues(
        I.missing_field(d, "doc_id", "text", "missing_text"),
        I.outside_vocabulary(d, "doc_id", "source", ["web", "books", "forum"], "source_vocabulary"),
        I.too_wordy(d, "doc_id", "text", 400, "wordy"),
        I.shape_differs(p, "page_id", "url", "^https://[a-z0-9.-]+/", "url_shape"),
        I.absent(d, "lang", ["en", "xx"], "required_lang"),
        I.out_of_range(d, "doc_id", F.col("n_chars").between(10, 3000), F.col("n_chars"), "provenance"),
    )


@P.add("""SELECT l_orderkey || '/' || l_linenumber AS object_id, l_returnflag AS detail FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS q, CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS l_returnflag FROM lineitem)
 WHERE l_returnflag <> CASE WHEN q >= 0.75 THEN 'high' WHEN q >= 0.4 THEN 'medium' ELSE 'low' END""")
def confidence_levels(t):
    """Levels that do not follow from their scores."""
    level = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
    rows = t("lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_quantity") / 50).alias("q"), level.alias("level"))
    return I.level_differs(rows, "id", F.col("q"), F.col("level"), "level").select("object_id", "detail")


@P.add(f"""{_RECURSIVE}, c AS (SELECT DISTINCT source AS node, 0 AS level FROM e WHERE source NOT IN (SELECT target FROM e) UNION SELECT e.target, c.level + 1 FROM c JOIN e ON c.node = e.source)
 SELECT node, level, row_number() OVER (ORDER BY level, node) - 1 AS position FROM (SELECT node, max(level) AS level FROM c GROUP BY 1)""")
def topological_order(t):
    """An order in which every dependency comes first: level by level, smaller ids first."""
    e = tree(t)
    levels = kept(G.levels(e, e.select(F.col("source").alias("node")).union(e.select("target"))))
    return L.in_order(levels, ["level", "node"]).select("node", "level", F.col("position").cast("long").alias("position"))


@P.add("SELECT CAST(l_orderkey AS VARCHAR) AS object_id, CAST(l_partkey AS VARCHAR) AS detail FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN (SELECT o_orderkey, o_orderkey * 7 % 1000 AS a FROM orders) ON o_orderkey = l_orderkey JOIN (SELECT p_partkey, p_partkey * 3 % 1000 AS b FROM part) ON p_partkey = l_partkey WHERE b >= a")
def misordered_dependencies(t):
    """Dependencies that a given order does not put first."""
    e = t("lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).distinct()
    at = t("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), (F.col("o_orderkey") * 7 % 1000).alias("position")).union(t("part").select(F.concat(F.lit("p"), "p_partkey"), F.col("p_partkey") * 3 % 1000))
    return I.misordered(e, at, "order").select(F.expr("substring(object_id, 2)").alias("object_id"), F.expr("substring(detail, 2)").alias("detail"))


_LOOPS = "e AS (SELECT s_suppkey AS source, (s_suppkey * s_suppkey + 1) % (SELECT count(*) FROM supplier) AS target FROM supplier UNION SELECT s_suppkey, s_suppkey // 2 FROM supplier)"


@P.add(f"WITH RECURSIVE {_LOOPS}, c AS (SELECT source AS a, target AS b FROM e UNION SELECT c.a, e.target FROM c JOIN e ON c.b = e.source) SELECT a AS node FROM c WHERE a = b")
def cycle_nodes(t):
    """Nodes on a cycle of a graph in which suppliers refer to others by two rules."""
    s = t("supplier").select("s_suppkey")
    n = s.agg(F.count("*").alias("n"))  # one row
    a = s.crossJoin(n).select(F.col("s_suppkey").alias("source"), ((F.col("s_suppkey") * F.col("s_suppkey") + 1) % F.col("n")).alias("target"))
    return R.strong_components(a.union(s.select("s_suppkey", F.floor(F.col("s_suppkey") / 2).cast("long")))).select("node")


@P.add(f"""{_RECURSIVE}, c AS (SELECT DISTINCT source AS node, [source] AS path FROM e WHERE source NOT IN (SELECT target FROM e) UNION SELECT e.target, list_append(c.path, e.target) FROM c JOIN e ON c.node = e.source)
 SELECT node, array_to_string(arg_min(path, {{'n': len(path), 'p': path}}), '/') AS chain FROM c GROUP BY 1""")
def shortest_chains(t):
    """The shortest chain from a root to each node, the least of equal ones."""
    e = tree(t)
    roots = e.select(F.col("source").alias("node")).distinct().join(e.select(F.col("target").alias("node")), "node", "left_anti")
    return G.shortest_paths(e, roots).select("node", F.array_join("path", "/").alias("chain"))


@P.add(f"""{_RECURSIVE}, x AS (SELECT source AS node, 0 AS i, 1 AS o, CAST(NULL AS VARCHAR) AS s FROM e UNION ALL SELECT target, 1, 0, source FROM e) SELECT node, CAST(sum(i) AS BIGINT) AS n_sources, CAST(sum(o) AS BIGINT) AS n_targets, min(s) AS first_source FROM x GROUP BY 1""")
def node_adjacency(t):
    """How many sources and targets each node has, and its first source."""
    e = tree(t)
    x = e.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast("string").alias("s")).union(e.select("target", F.lit(1), F.lit(0), "source"))
    return x.groupBy("node").agg(F.sum("i").alias("n_sources"), F.sum("o").alias("n_targets"), F.min("s").alias("first_source"))


@P.add("""WITH p AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey AS path, 3 AS depth FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey, 2 FROM nation UNION ALL SELECT 'r' || r_regionkey, 1 FROM region)
 SELECT path, CAST(depth AS INT) AS depth, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS position FROM p""")
def preorder(t):
    """A nested tree flattened in pre-order."""
    up = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("node"), (F.concat(F.lit(b), y) if b else F.lit(None).cast("string")).alias("parent"))
    rows = up(t("supplier"), "s", "s_suppkey", "n", "s_nationkey").unionByName(up(t("nation"), "n", "n_nationkey", "r", "n_regionkey")).unionByName(up(t("region"), "r", "r_regionkey", "", ""))
    found = L.in_order(G.paths(rows).select("path"), ["path"])
    return found.select(F.array_join("path", "/").alias("path"), F.size("path").alias("depth"), F.col("position").cast("long").alias("position"))


_LINES = "l AS (SELECT doc_id, i AS line_idx, x[i + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) WHERE length(trim(x[i + 1], ' ')) > 0)"
_MERGED = """m AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_idx) AS before FROM l), b AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND ({rule}) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS block FROM m)
 SELECT doc_id, CAST(block AS BIGINT) AS block, CAST(min(line_idx) AS INT) AS first_line, count(*) AS n_lines, md5(string_agg(line, ' ' ORDER BY line_idx)) AS text_md5 FROM b GROUP BY 1, 2"""


@P.add(f"WITH {_LINES}, " + _MERGED.replace("{rule}", "NOT regexp_matches(before, '[.!?:]\\s*$') AND regexp_matches(line, '^\\s*[a-z]')"))
def wrapped_lines(t):
    """Lines that end without a full stop, joined with those that go on in small letters."""
    goes_on = ~F.col("before").rlike(r"[.!?:]\s*$") & F.col("line").rlike(r"^\s*[a-z]")
    lines = S.text_lines(t("documents"), "doc_id", "text")
    return O.merged_runs(lines, "doc_id", "line_idx", "line", goes_on).select("doc_id", "block", "first_line", "n_lines", F.md5("text").alias("text_md5"))


@P.add(f"WITH {_LINES}, " + _MERGED.replace("{rule}", "regexp_matches(line, '^\\s*[=+\\-*/]') OR regexp_matches(before, '[=+\\-*/,]\\s*$')"))
def merged_continuations(t):
    """Lines that begin with an operator, or follow one that ends in one, joined with the line before."""
    goes_on = F.col("line").rlike(r"^\s*[=+\-*/]") | F.col("before").rlike(r"[=+\-*/,]\s*$")
    lines = S.text_lines(t("documents"), "doc_id", "text")
    return O.merged_runs(lines, "doc_id", "line_idx", "line", goes_on).select("doc_id", "block", "first_line", "n_lines", F.md5("text").alias("text_md5"))


def folder(t, name: str) -> str:
    """A new folder beside other intermediate tables."""
    return f"{session_folder(t('nation').sparkSession)}/{name}-{uuid.uuid4().hex}"


@P.add(f"SELECT build_id, count(*) AS n_artifacts, count(DISTINCT fingerprint) AS n_fingerprints FROM ({_SNAP}) GROUP BY 1")
def build_history(t):
    """Snapshots persisted by build, and the builds listed from what was written."""
    path = folder(t, "snapshots")
    B.persist_snapshot(snapshots(t), path)
    kept = t("nation").sparkSession.read.option("basePath", path).parquet(path)
    return kept.groupBy(F.col("build_id").cast("string").alias("build_id")).agg(F.count("*").alias("n_artifacts"), F.count_distinct("fingerprint").alias("n_fingerprints"))


@P.add(f"WITH s AS ({_SNAP}) SELECT artifact, fingerprint FROM s WHERE build_id = (SELECT max(build_id) FROM s WHERE build_id < '2024-01-20')")
def previous_snapshot(t):
    """The snapshot of the last build before a day, from what was written: one folder is read."""
    path, spark = folder(t, "snapshots"), t("nation").sparkSession
    B.persist_snapshot(snapshots(t), path)
    builds = spark.read.parquet(path).select(F.col("build_id").cast("string").alias("build_id"), F.lit(True).alias("valid")).distinct()
    last = B.previous_build(builds, "2024-01-20").first()["build_id"]
    return B.load_snapshot(spark, path, last).select("artifact", "fingerprint")


@P.add(f"{_TREE} SELECT 'edge' AS part, substr(source, 1, 1) || substr(target, 1, 1) AS kind, count(*) AS n FROM e GROUP BY 1, 2 UNION ALL SELECT 'node', substr(x, 1, 1), count(*) FROM (SELECT source AS x FROM e UNION SELECT target FROM e) GROUP BY 1, 2")
def persisted_graph(t):
    """Nodes and edges written to folders by kind, and counted from what was written."""
    path, spark = folder(t, "graph"), t("nation").sparkSession
    e = tree(t)
    e.withColumn("kind", F.concat(F.substring("source", 1, 1), F.substring("target", 1, 1))).write.partitionBy("kind").parquet(f"{path}/edges")
    held = spark.read.parquet(f"{path}/edges")
    nodes_ = held.select(F.col("source").alias("node")).union(held.select("target")).distinct()
    nodes_.withColumn("kind", F.substring("node", 1, 1)).write.partitionBy("kind").parquet(f"{path}/nodes")
    n = spark.read.parquet(f"{path}/nodes").groupBy(F.lit("node").alias("part"), "kind").agg(F.count("*").alias("n"))
    return held.groupBy(F.lit("edge").alias("part"), "kind").agg(F.count("*").alias("n")).unionByName(n)


@P.add("SELECT conv_id, count(*) AS n_turns, md5(string_agg(text, '|' ORDER BY turn)) AS texts_md5 FROM conversations GROUP BY 1")
def json_documents(t):
    """Documents with nested parts written as JSON by kind and read again with their schema."""
    path, spark = folder(t, "documents"), t("nation").sparkSession
    c = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    B.write_documents(c.withColumn("part", F.pmod("conv_id", F.lit(8))), path, "part")
    held = spark.read.schema("conv_id long, turns array<struct<turn: long, text: string>>").json(path)
    return held.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.md5(F.array_join(F.transform("turns", lambda r: r["text"]), "|")).alias("texts_md5"))


@P.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def still_to_do(t):
    """Documents that have no label yet."""
    return B.still_to_do(t("documents").select("doc_id"), t("labels"), "doc_id")


@P.add("SELECT p_partkey, CASE WHEN p_partkey % 50 = 7 THEN 'missing' WHEN p_partkey % 30 = 3 THEN 'differs' ELSE 'verified' END AS status FROM part")
def verified_copies(t):
    """Whether the copy of each row is there and the same."""
    p = t("part").select("p_partkey", "p_name")
    copy = p.where("p_partkey % 50 <> 7").withColumn("p_name", F.when(F.col("p_partkey") % 30 == 3, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")))
    return B.copied_right(p, copy, "p_partkey", "p_name")
