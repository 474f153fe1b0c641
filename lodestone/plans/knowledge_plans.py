"""Teaching units, paths, links, retrieval indexes, search through postings and graph checks: concepts are suppliers, edges come from neighbouring order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import knowledge as K
from ..operators import lookup as L
from ..operators import reach as R
from ..operators import search as S
from ..sources.shared import kept
from .base import Plans, quoted, quoted_list
from .lookup_plans import _RES, resources
from .rule_plans import folder
from .structure_plans import _ITEMS, items

P = Plans()
TYPES = ("REQUIRES", "RECOMMENDED_BEFORE", "RELATED_TO")
ROLES = ("defines_concept", "exemplifies_concept", "serves_visual_purpose", "expresses_comparison", "sequences_instruction", "describes_strategy", "surfaces_misconception", "other")

#: A concept needs those of a lesser class (of four) that stand beside it in an order.
_DEP = f"""{_ITEMS}, pairs AS (SELECT CASE WHEN a.l_suppkey % 4 < b.l_suppkey % 4 THEN a.l_suppkey ELSE b.l_suppkey END AS source, CASE WHEN a.l_suppkey % 4 < b.l_suppkey % 4 THEN b.l_suppkey ELSE a.l_suppkey END AS target,
  list_extract({quoted_list(TYPES)}, CAST(b.l_partkey % 3 + 1 AS INT)) AS edge_type, b.l_linestatus = 'F' AS is_blocking, b.node AS edge_id, round(b.l_discount * 12, 4) AS confidence
 FROM i a JOIN i b ON a.node + 1 = b.node AND a.l_orderkey = b.l_orderkey WHERE a.l_suppkey % 4 <> b.l_suppkey % 4)"""


def dependencies(t):
    a, b = items(t).alias("a"), items(t).alias("b")
    both = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.node") + 1 == F.col("b.node"))).where("a.l_suppkey % 4 <> b.l_suppkey % 4")
    up = F.col("a.l_suppkey") % 4 < F.col("b.l_suppkey") % 4
    pick = lambda x, y: F.when(up, F.col(x)).otherwise(F.col(y))
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.col("b.l_partkey") % 3 + 1).cast("int"))
    return both.select(pick("a.l_suppkey", "b.l_suppkey").alias("source"), pick("b.l_suppkey", "a.l_suppkey").alias("target"), kind.alias("edge_type"), (F.col("b.l_linestatus") == "F").alias("is_blocking"), F.col("b.node").alias("edge_id"), F.round(F.col("b.l_discount") * 12, 4).alias("confidence"))


_REFS = "refs AS (SELECT target AS concept_id, source AS prerequisite_id, arg_min(is_blocking, edge_id) AS is_blocking, min(edge_id) AS edge_id FROM pairs WHERE edge_type IN ('REQUIRES', 'RECOMMENDED_BEFORE') GROUP BY 1, 2)"


@P.add(f"WITH {_DEP}, {_REFS} SELECT concept_id, prerequisite_id, is_blocking, CAST(row_number() OVER (PARTITION BY concept_id ORDER BY edge_id, prerequisite_id) AS INT) AS nth FROM refs")
def unit_prerequisites(t):
    """The prerequisites of each unit in the order of their first edges."""
    return K.prerequisite_refs(dependencies(t), TYPES[:2])


_HAS = {"explanation": ("application", "analogy"), "objective": ("activity",), "example": ("example", "worked_example"), "assessment": ("assessment", "question"), "note": ("note",), "figure": ("figure",)}
_HAS_SQL = ", ".join(f"bool_or(kind IN ({', '.join(quoted(k) for k in kinds)})) AS {name}" for name, kinds in _HAS.items())
_WEIGHED = " + ".join(f"{w} * CAST(coalesce({name}, false) AS INT)" for name, w in K.COMPLETENESS if name in _HAS)


@P.add(f"""WITH {_DEP}, {_REFS}, p AS (SELECT concept_id, count(*) AS n, CAST(sum(CAST(is_blocking AS INT)) AS BIGINT) AS blocking FROM refs GROUP BY 1), h AS (SELECT concept_id, {_HAS_SQL}, sum(minutes) AS minutes FROM {_RES} GROUP BY 1)
 SELECT s_suppkey AS concept_id, coalesce(n, 0) AS n_prerequisites, coalesce(blocking, 0) AS n_blocking, round(({_WEIGHED} + 3 * CAST(s_name <> '' AS INT) + 2 * CAST(n IS NOT NULL AS INT) + CAST(s_acctbal > 0 AS INT) + CAST(coalesce(minutes, 0) > 0 AS INT)) / 18, 4) AS completeness
 FROM supplier LEFT JOIN p ON p.concept_id = s_suppkey LEFT JOIN h ON h.concept_id = s_suppkey""")
def unit_backfill(t):
    """Units with their prerequisites counted in, and how complete they are then."""
    held = resources(t).groupBy("concept_id").agg(*(F.bool_or(F.col("kind").isin(*kinds)).alias(name) for name, kinds in _HAS.items()), F.sum("minutes").alias("minutes"))
    units = t("supplier").select(F.col("s_suppkey").alias("concept_id"), "s_name", "s_acctbal").join(held, "concept_id", "left")
    has = {name: F.col(name) for name in _HAS} | {"definition": F.col("s_name") != "", "bloom": F.col("s_acctbal") > 0, "time": F.col("minutes") > 0}
    return K.backfilled(units, K.prerequisite_refs(dependencies(t), TYPES[:2]), has).select("concept_id", "n_prerequisites", "n_blocking", "completeness")


_ORDER = """lev AS (SELECT s_suppkey AS node, 0 AS level FROM supplier WHERE s_suppkey NOT IN (SELECT target FROM pairs) UNION SELECT DISTINCT p.target, lev.level + 1 FROM lev JOIN (SELECT DISTINCT source, target FROM pairs) p ON p.source = lev.node),
 o AS (SELECT node AS concept_id, row_number() OVER (ORDER BY level, node) - 1 AS position, s_acctbal, s_name, s_nationkey FROM (SELECT node, max(level) AS level FROM lev GROUP BY 1) JOIN supplier ON s_suppkey = node)"""


def concept_order(t):
    """Concepts in topological order, a level at a time."""
    e = kept(dependencies(t).select("source", "target").distinct())
    levels = kept(G.levels(e, t("supplier").select(F.col("s_suppkey").alias("node"))))
    return L.in_order(levels, ["level", "node"]).join(t("supplier"), F.col("node") == F.col("s_suppkey")).withColumnRenamed("node", "concept_id")


@P.add(f"""WITH RECURSIVE {_DEP}, {_ORDER}, r AS (SELECT concept_id, bool_or(kind = 'worked_example') AS ex, CAST(sum(minutes) AS DOUBLE) AS minutes FROM {_RES} GROUP BY 1),
 x AS (SELECT o.concept_id, position, s_acctbal < 0 AS opt, coalesce(ex, false) AS ex, coalesce(minutes, 0.0) AS minutes FROM o LEFT JOIN r ON r.concept_id = o.concept_id)
 SELECT 'minimal_prerequisites' AS path_type, row_number() OVER w AS position, concept_id, round(sum(minutes) OVER w, 6) AS minutes_so_far FROM x WHERE NOT opt WINDOW w AS (ORDER BY position)
 UNION ALL SELECT 'example_first', row_number() OVER w, concept_id, round(sum(minutes) OVER w, 6) FROM x WINDOW w AS (ORDER BY CASE WHEN ex THEN 0 ELSE 1 END, position)""")
def alternative_paths(t):
    """Two other ways through the concepts: without optional ones, and those with worked examples first."""
    r = resources(t).groupBy("concept_id").agg(F.bool_or(F.col("kind") == "worked_example").alias("has_examples"), F.sum("minutes").cast("double").alias("minutes"))
    rows = concept_order(t).join(r, "concept_id", "left").select("concept_id", "position", (F.col("s_acctbal") < 0).alias("is_optional"), F.coalesce("has_examples", F.lit(False)).alias("has_examples"), "minutes")
    return K.alternative_paths(kept(rows))


_ROLE = f"(SELECT s_suppkey AS node, list_extract({quoted_list(ROLES)}, CAST(s_suppkey * 5 % {len(ROLES)} + 1 AS INT)) AS role, (s_suppkey % 7) / 8 AS confidence FROM supplier)"
_PAIRS = lambda name, pairs: f"SELECT '{name}' AS link_type, a.role AS source_role, a.confidence AS source_confidence, b.role AS target_role, b.confidence AS target_confidence, round((a.confidence + b.confidence) / 2, 4) AS confidence, count(*) AS n_links FROM {_ROLE} a JOIN {_ROLE} b ON a.node < b.node WHERE (a.role, b.role) IN ({', '.join(str(p) for p in pairs)}) GROUP BY ALL"


def roles(t):
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("s_suppkey") * 5 % len(ROLES) + 1).cast("int"))
    return t("supplier").select(F.col("s_suppkey").alias("node"), role.alias("role"), ((F.col("s_suppkey") % 7) / 8).alias("confidence"))


@P.add(f"{_PAIRS('reinforcing', K.REINFORCING)} UNION ALL {_PAIRS('contrasting', K.CONTRASTING)}")
def role_links(t):
    """Reinforcing and contrasting links from earlier to later concepts, by classes of role and confidence; the SQL forms all pairs and counts them."""
    return K.role_links(roles(t), {"reinforcing": K.REINFORCING, "contrasting": K.CONTRASTING})


@P.add(f"""WITH {_DEP}, d AS (SELECT source, target, least(1.0, coalesce(arg_min(confidence, edge_id), 0.7)) AS c FROM pairs GROUP BY 1, 2), rel AS (SELECT DISTINCT concept_id AS source, item_id AS target FROM {_RES} WHERE kind = 'related')
 SELECT source, target, 'prerequisite' AS link_type, CAST(c AS DOUBLE) AS confidence FROM d UNION ALL SELECT target, source, 'successor', CAST(c AS DOUBLE) FROM d
 UNION ALL SELECT rel.source, rel.target, 'related_concept', CAST(round((coalesce(a.confidence, 0.5) + coalesce(b.confidence, 0.5)) / 2, 4) AS DOUBLE) FROM rel LEFT JOIN {_ROLE} a ON a.node = rel.source LEFT JOIN {_ROLE} b ON b.node = rel.target""")
def dependency_links(t):
    """Links to prerequisites, successors and related concepts."""
    related = resources(t).where("kind = 'related'").select(F.col("concept_id").alias("source"), F.col("item_id").alias("target"))
    return K.dependency_links(dependencies(t), related, roles(t))


@P.add(f"""WITH RECURSIVE {_DEP}, {_ORDER}, n AS (SELECT kind, position, o.concept_id, item_id, row_number() OVER (PARTITION BY o.concept_id, kind ORDER BY ord, item_id) AS nth FROM {_RES} r JOIN o ON o.concept_id = r.concept_id WHERE kind IN ('note', 'formula'))
 SELECT kind AS index, position, concept_id, CAST(nth AS INT) AS nth, CAST(item_id AS VARCHAR) AS entry FROM n UNION ALL SELECT 'definition', position, concept_id, 1, s_name FROM o WHERE s_name <> ''
 UNION ALL SELECT 'core', position, concept_id, 1, CAST(concept_id AS VARCHAR) FROM o WHERE s_nationkey % 3 = 0""")
def revision_index(t):
    """Notes, formulae, definitions and core concepts for revision, in topological order."""
    importance = F.when(F.col("s_nationkey") % 3 == 0, "core").otherwise("supporting")
    order = kept(concept_order(t).select("concept_id", "position", importance.alias("importance"), F.col("s_name").alias("definition")))
    return K.revision_index(order, resources(t))


@P.add(f"""WITH {_DEP} SELECT 'by_concept' AS index, CAST(s_suppkey AS VARCHAR) AS concept_id, CAST(edge_id AS VARCHAR) AS entry FROM pairs JOIN supplier ON source = s_suppkey WHERE s_suppkey % 10 <> 9
 UNION ALL SELECT 'cross_chapter', NULL, CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F'""")
def traversal_index(t):
    """Edges by concept, and links between chapters."""
    nodes = t("supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 10 != 9, F.col("s_suppkey")).alias("concept_id"))
    links = t("orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("link_id"))
    return K.traversal_index(nodes, dependencies(t), links)


_GRAPH = f"{_ITEMS}, n AS (SELECT s_suppkey AS node FROM supplier UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey % 40 = 3), e AS (SELECT node - node % 3 AS edge_id, l_suppkey AS source, CASE WHEN l_partkey % 11 = 0 THEN l_partkey + 1000000 ELSE (l_suppkey + l_partkey % 4) % 90 END AS target, l_returnflag AS type, l_discount * 12 AS confidence FROM i WHERE l_suppkey % 20 <> 7 AND l_quantity < 4)"


@P.add(f"""WITH RECURSIVE {_GRAPH}, c AS (SELECT DISTINCT source AS a, target AS b FROM e UNION SELECT c.a, e.target FROM c JOIN e ON c.b = e.source), s AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
 SELECT 'GIV001' AS rule, 'ERROR' AS severity, CAST(node AS VARCHAR) AS object_id, CAST(count(*) AS VARCHAR) AS detail FROM n GROUP BY node HAVING count(*) > 1 UNION ALL SELECT 'GIV002', 'WARNING', CAST(edge_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM e GROUP BY edge_id HAVING count(*) > 1
 UNION ALL SELECT 'GIV003', 'ERROR', CAST(edge_id AS VARCHAR), CAST(source AS VARCHAR) FROM e WHERE source NOT IN (SELECT node FROM n) UNION ALL SELECT 'GIV004', 'ERROR', CAST(edge_id AS VARCHAR), CAST(target AS VARCHAR) FROM e WHERE target NOT IN (SELECT node FROM n)
 UNION ALL SELECT 'GIV005', 'ERROR', CAST(edge_id AS VARCHAR), type FROM e WHERE type NOT IN ('R', 'N') UNION ALL SELECT 'GIV006', 'ERROR', CAST(edge_id AS VARCHAR), CAST(CAST(round(confidence, 4) AS DOUBLE) AS VARCHAR) FROM e WHERE confidence NOT BETWEEN 0 AND 1
 UNION ALL SELECT DISTINCT 'GIV007', 'WARNING', CAST(node AS VARCHAR), 'orphan' FROM n WHERE node NOT IN (SELECT source FROM e UNION ALL SELECT target FROM e) UNION ALL SELECT 'GIV008', 'WARNING', CAST(component AS VARCHAR), CAST(count(*) AS VARCHAR) FROM s GROUP BY component""")
def graph_issues(t):
    """The eight checks of a graph whose nodes and edges are partly repeated, broken, mistyped, unsure, alone or circular."""
    i, s = items(t), t("supplier").select(F.col("s_suppkey").alias("node"))
    target = F.when(F.col("l_partkey") % 11 == 0, F.col("l_partkey") + 1_000_000).otherwise((F.col("l_suppkey") + F.col("l_partkey") % 4) % 90)
    edges = i.where("l_suppkey % 20 <> 7 and l_quantity < 4").select((F.col("node") - F.col("node") % 3).alias("edge_id"), F.col("l_suppkey").alias("source"), target.alias("target"), F.col("l_returnflag").alias("type"), F.round(F.col("l_discount") * 12, 4).alias("confidence"))
    return K.graph_issues(s.union(s.where("node % 40 = 3")), kept(edges), ["R", "N"])


@P.add("""WITH q AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')[1:3]) AS w FROM conversations WHERE turn = 0), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM documents),
 s AS (SELECT conv_id, doc_id, len(list_intersect(w, t)) / greatest(len(w), len(t)) AS score FROM q JOIN d ON len(list_intersect(w, t)) > 0)
 SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s QUALIFY rank <= 10""")
def search_batch(t):
    """The ten best documents for the first words of every conversation, through a written index of postings."""
    path = folder(t, "postings")
    S.write_index(t("documents"), "doc_id", "text", path)
    first = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), 1, 3)
    queries = t("conversations").where("turn = 0").select("conv_id", first.alias("words"))
    found = S.search_index(t("nation").sparkSession.read.parquet(path), queries, "conv_id", "words")
    return found.select(F.col("query_id").alias("conv_id"), "rank", F.col("key").alias("doc_id"), "score")


@P.add(f"""WITH RECURSIVE {_DEP}, {_ORDER}, d AS (SELECT DISTINCT source, target FROM pairs WHERE edge_type = 'REQUIRES'), c AS (SELECT s_suppkey AS goal, s_suppkey AS concept_id FROM supplier WHERE s_suppkey % 5 = 0 UNION SELECT c.goal, d.source FROM c JOIN d ON d.target = c.concept_id)
 SELECT goal, CAST(row_number() OVER (PARTITION BY goal ORDER BY position, c.concept_id) AS INT) AS nth, c.concept_id FROM c JOIN o ON o.concept_id = c.concept_id""")
def goal_paths(t):
    """For every fifth concept, all that it requires, directly or not, in topological order."""
    edges = dependencies(t).where("edge_type = 'REQUIRES'").select("source", "target")
    goals = t("supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("goal"))
    return K.ordered_paths(goals, R.reaching_by_masks(goals, edges), kept(concept_order(t).select("concept_id", "position")))
