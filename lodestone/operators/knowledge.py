"""Units of teaching over a dependency graph: prerequisites, completeness, paths, links, retrieval indexes and graph checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import integrity as I
from .lookup import in_order
from .reach import reaching, strong_components
from .scan import Rule, in_ranges, scan

# What a unit must have, and its weight.
COMPLETENESS = (
    ("definition", 3),
    ("explanation", 3),
    ("objective", 2),
    ("example", 2),
    ("prerequisite", 2),
    ("assessment", 2),
    ("bloom", 1),
    ("note", 1),
    ("figure", 1),
    ("time", 1),
)

# Roles of an earlier and a later concept that reinforce or contrast each other.
REINFORCING = (
    ("defines_concept", "exemplifies_concept"),
    ("exemplifies_concept", "defines_concept"),
    ("defines_concept", "serves_visual_purpose"),
    ("defines_concept", "expresses_comparison"),
    ("sequences_instruction", "describes_strategy"),
)
CONTRASTING = (
    ("defines_concept", "surfaces_misconception"),
    ("surfaces_misconception", "defines_concept"),
)


def completeness(has: dict[str, Column]) -> Column:
    """The weighted share of what a unit has, four places; what is not named is not there."""
    got = sum((F.when(F.coalesce(has[name], F.lit(False)), w).otherwise(0) for name, w in COMPLETENESS if name in has), F.lit(0))
    return F.round(got / sum(w for _, w in COMPLETENESS), 4)


def prerequisite_refs(edges: DataFrame, types: Sequence[str]) -> DataFrame:
    """(concept_id, prerequisite_id, is_blocking, nth): the first edge of each pair, in the order of edge ids.

    ``edges``: (source, target, edge_type, is_blocking, edge_id); the source is what the target needs.
    """
    some = edges.where(F.col("edge_type").isin(*types) & F.col("source").isNotNull() & F.col("target").isNotNull())
    once = some.groupBy(F.col("target").alias("concept_id"), F.col("source").alias("prerequisite_id")).agg(F.min_by("is_blocking", "edge_id").alias("is_blocking"), F.min("edge_id").alias("edge_id"))
    nth = F.row_number().over(Window.partitionBy("concept_id").orderBy("edge_id", "prerequisite_id"))
    return once.withColumn("nth", nth).select("concept_id", "prerequisite_id", "is_blocking", "nth")


def backfilled(units: DataFrame, refs: DataFrame, has: dict[str, Column]) -> DataFrame:
    """``units`` (concept_id, ...) with their number of prerequisites, how many of them block, and completeness with these counted in."""
    n = refs.groupBy("concept_id").agg(F.count("*").alias("n_prerequisites"), F.sum(F.coalesce("is_blocking", F.lit(True)).cast("long")).alias("n_blocking"))
    joined = units.join(n, "concept_id", "left").fillna(0, ["n_prerequisites", "n_blocking"])
    return joined.withColumn("completeness", completeness(has | {"prerequisite": F.col("n_prerequisites") > 0}))


def alternative_paths(order: DataFrame) -> DataFrame:
    """(path_type, position, concept_id, minutes_so_far) from (concept_id, position, is_optional, has_examples, minutes) in topological order.

    'minimal_prerequisites' leaves optional concepts out; 'example_first', if any concept has examples, puts those first; both
    keep the order otherwise. Fewer than two concepts have no other path.
    """
    kinds = [
        ("minimal_prerequisites", order.where(~F.coalesce("is_optional", F.lit(False))), F.lit(0)),
        ("example_first", order.join(order.where("has_examples").limit(1).select(F.lit(True).alias("_any")), how="cross"), F.when(F.col("has_examples"), 0).otherwise(1)),
    ]
    enough = order.limit(2).count() == 2
    found = [rows.select(F.lit(name).alias("path_type"), first.alias("_first"), F.col("position").alias("_at"), "concept_id", F.coalesce("minutes", F.lit(0.0)).alias("minutes")) for name, rows, first in kinds]
    both = in_order(found[0].unionByName(found[1]).where(F.lit(enough)), ["path_type", "_first", "_at"])
    # sums over all before: within ranges of positions, and of the ranges before
    block = F.floor(F.col("position") / 4096)
    held = both.withColumn("_block", block)
    sums = held.groupBy("path_type", "_block").agg(F.sum("minutes").alias("_m"), F.count("*").alias("_n"))
    w = Window.partitionBy("path_type").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("path_type", "_block", F.coalesce(F.sum("_m").over(w), F.lit(0.0)).alias("_m"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("path_type", "_block").orderBy("position")
    out = held.join(before, ["path_type", "_block"])
    return out.select("path_type", (F.row_number().over(inside) + F.col("_n")).cast("long").alias("position"), "concept_id", F.round(F.sum("minutes").over(inside) + F.col("_m"), 6).alias("minutes_so_far"))


class Tally(Rule):
    """How many rows of each class came before a row, for the classes whose role its own role pairs with; a class is a role and a confidence.

    The state has a count for each class, so its size follows the number of roles and of different confidences.
    """

    columns = ("role", "confidence")
    output = "before array<struct<role: string, confidence: double, n: bigint>>"

    def __init__(self, pairs: Sequence[tuple[str, str]]):
        self.firsts: dict[str, list[str]] = {}
        for a, b in pairs:
            self.firsts.setdefault(b, []).append(a)

    def start(self):
        return {}

    empty = start

    def add(self, state, role, confidence):
        of = state.setdefault(role, {})
        of[repr(confidence)] = of.get(repr(confidence), 0) + 1

    def step(self, state, rows):
        out = []
        for role, confidence in zip(rows["role"], rows["confidence"], strict=True):
            out.append([{"role": a, "confidence": float(c), "n": n} for a in self.firsts.get(role, ()) for c, n in state.get(a, {}).items()])
            if role is not None and confidence is not None:
                self.add(state, role, confidence)
        return state, {"before": out}

    def extend(self, summary, rows):
        for role, confidence in zip(rows["role"], rows["confidence"], strict=True):
            if role is not None and confidence is not None:
                self.add(summary, role, confidence)
        return summary

    def after(self, state, summary):
        return {r: {c: state.get(r, {}).get(c, 0) + summary.get(r, {}).get(c, 0) for c in state.get(r, {}).keys() | summary.get(r, {}).keys()} for r in state.keys() | summary.keys()}


def role_links(concepts: DataFrame, pairs: dict[str, Sequence[tuple[str, str]]], parts: int | None = None) -> DataFrame:
    """(link_type, source_role, source_confidence, target_role, target_confidence, confidence, n_links): pairs of an earlier and a later concept
    whose roles pair, by classes of role and confidence, so that no pair is written; ``concepts``: (node, role, confidence)."""
    ranged = in_ranges(concepts.withColumn("_all", F.lit(0)), "_all", "node", parts=parts)
    found = []
    for name, some in pairs.items():
        each = scan(ranged, Tally(some)).select("role", "confidence", F.explode("before").alias("b"))
        n = each.groupBy(F.col("b.role").alias("source_role"), F.col("b.confidence").alias("source_confidence"), F.col("role").alias("target_role"), F.col("confidence").alias("target_confidence")).agg(F.sum("b.n").alias("n_links"))
        found.append(n.select(F.lit(name).alias("link_type"), "source_role", "source_confidence", "target_role", "target_confidence", F.round((F.col("source_confidence") + F.col("target_confidence")) / 2, 4).alias("confidence"), "n_links"))
    return reduce(DataFrame.unionByName, found)


def dependency_links(edges: DataFrame, related: DataFrame, confidence: DataFrame) -> DataFrame:
    """(source, target, link_type, confidence): a prerequisite and a successor link for each edge (the first by edge id of a pair), and one for each related pair.

    ``edges``: (source, target, confidence, edge_id); ``related``: (source, target); ``confidence``: (node, confidence), 0.5 where a node has none.
    """
    once = edges.where("source is not null and target is not null").groupBy("source", "target").agg(F.min_by("confidence", "edge_id").alias("c"))
    sure = F.least(F.lit(1.0), F.coalesce("c", F.lit(0.7)))
    there = once.select("source", "target", F.lit("prerequisite").alias("link_type"), sure.alias("confidence"))
    back = once.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("successor").alias("link_type"), sure.alias("confidence"))
    of = lambda end: confidence.select(F.col("node").alias(end), F.col("confidence").alias(f"_{end}"))
    pairs = related.where("source is not null and target is not null").select("source", "target").distinct().join(of("source"), "source", "left").join(of("target"), "target", "left")
    mean = F.round((F.coalesce("_source", F.lit(0.5)) + F.coalesce("_target", F.lit(0.5))) / 2, 4)
    return there.unionByName(back).unionByName(pairs.select("source", "target", F.lit("related_concept").alias("link_type"), mean.alias("confidence")))


def revision_index(order: DataFrame, items: DataFrame) -> DataFrame:
    """(index, position, concept_id, entry): notes by concept, formulae, definitions and core concepts in topological order.

    ``order``: (concept_id, position, importance, definition); ``items``: (concept_id, kind, ord, item_id).
    """
    def of_kind(kind: str, name: str) -> DataFrame:
        rows = items.where(F.col("kind") == kind).join(order.select("concept_id", "position"), "concept_id")
        nth = F.row_number().over(Window.partitionBy("concept_id").orderBy("ord", "item_id"))
        return rows.select(F.lit(name).alias("index"), "position", "concept_id", nth.alias("nth"), F.col("item_id").cast("string").alias("entry"))

    definitions = order.where("definition <> ''").select(F.lit("definition").alias("index"), "position", "concept_id", F.lit(1).alias("nth"), F.col("definition").alias("entry"))
    core = order.where(F.coalesce("importance", F.lit("core")) == "core").select(F.lit("core").alias("index"), "position", "concept_id", F.lit(1).alias("nth"), F.col("concept_id").cast("string").alias("entry"))
    return of_kind("note", "note").unionByName(of_kind("formula", "formula")).unionByName(definitions).unionByName(core)


def traversal_index(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """(index, concept_id, entry): edges by the concept of their source node, and links between chapters. ``nodes``: (node, concept_id)."""
    by = edges.join(nodes.where("concept_id is not null").withColumnRenamed("node", "source"), "source")
    own = by.select(F.lit("by_concept").alias("index"), F.col("concept_id").cast("string").alias("concept_id"), F.col("edge_id").cast("string").alias("entry"))
    across = links.where("link_id is not null").select(F.lit("cross_chapter").alias("index"), F.lit(None).cast("string").alias("concept_id"), F.col("link_id").cast("string").alias("entry"))
    return own.unionByName(across)


def graph_issues(nodes: DataFrame, edges: DataFrame, types: Sequence[str], strict: bool = True, cycles: bool = True) -> DataFrame:
    """Issues (rule, severity, object_id, detail) of a graph: nodes (node), edges (edge_id, source, target, type, confidence).

    GIV001 repeated nodes, GIV002 repeated edges, GIV003 and GIV004 ends that no node has, GIV005 types that are none, GIV006 confidences
    outside 0 to 1, GIV007 nodes without edges, GIV008 cycles: a row for each set of nodes that share cycles, with their number.
    """
    broken = "ERROR" if strict else "WARNING"
    once = nodes.select("node").distinct()
    ends = lambda side, rule: I.issues(edges.join(once.withColumnRenamed("node", side), side, "left_anti"), rule, broken, F.col("edge_id"), F.col(side))
    repeated = edges.groupBy("edge_id").agg(F.count("*").alias("n")).where("n > 1")
    connected = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    found = [
        I.duplicate_id(nodes, "node", "GIV001"),
        I.issues(repeated, "GIV002", "WARNING", F.col("edge_id"), F.col("n")),
        ends("source", "GIV003"),
        ends("target", "GIV004"),
        I.issues(edges.where(~F.coalesce(F.col("type").isin(*types), F.lit(False))), "GIV005", "ERROR", F.col("edge_id"), F.col("type")),
        I.issues(edges.where(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))), "GIV006", "ERROR", F.col("edge_id"), F.col("confidence")),
        I.issues(once.join(connected, "node", "left_anti"), "GIV007", "WARNING", F.col("node"), F.lit("orphan")),
    ]
    if cycles:
        rings = strong_components(edges.select("source", "target")).groupBy("component").agg(F.count("*").alias("n"))
        found.append(I.issues(rings, "GIV008", "WARNING", F.col("component"), F.col("n")))
    return I.all_issues(*found)


def goal_paths(goals: DataFrame, labels: DataFrame, order: DataFrame) -> DataFrame:
    """(goal, nth, concept_id): what must be learnt for each goal, directly or not, in topological order, the goal last.

    ``labels``: from ``reach_labels`` over (prerequisite, concept); ``order``: (concept_id, position). A goal that the order lacks has no path.
    """
    return ordered_paths(goals, reaching(goals, labels), order)


def ordered_paths(goals: DataFrame, needs: DataFrame, order: DataFrame) -> DataFrame:
    """As ``goal_paths``, from ``needs`` (goal, node): what each goal requires, directly or not."""
    needed = needs.withColumnRenamed("node", "concept_id").join(order.select("concept_id", "position"), "concept_id")
    alone = goals.select("goal").distinct().join(order.select(F.col("concept_id").alias("goal"), "position"), "goal").select("goal", F.col("goal").alias("concept_id"), "position")
    nth = F.row_number().over(Window.partitionBy("goal").orderBy("position", "concept_id"))
    return needed.select("goal", "concept_id", "position").union(alone).distinct().withColumn("nth", nth).select("goal", "nth", "concept_id")
