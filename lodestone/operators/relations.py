"""Edges between records: generation, deduplication, co-occurrence, role rules and confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import make_id


def edges(rows: DataFrame, kind: str, source_type: str, source: Column, target_type: str, target: Column) -> DataFrame:
    """Relationship rows with an id made of their parts; rows without an end give none."""
    out = rows.select(F.lit(kind).alias("type"), F.lit(source_type).alias("source_type"), source.cast("string").alias("source_id"), F.lit(target_type).alias("target_type"), target.cast("string").alias("target_id"))
    out = out.where("source_id is not null and target_id is not null").distinct()
    return out.withColumn("id", make_id(F.concat_ws("_", "type", "source_type", "source_id", "target_type", "target_id")))


# What an item of a registry is to the concepts it names: its type, the relationship, and whether the concept is the source.
CONCEPT_RELATIONSHIPS = (
    ("definitions", "definition", "has_definition", True),
    ("glossary", "glossary_entry", "explains", False),
    ("glossary", "glossary_entry", "described_by", True),
    ("equations", "equation", "uses_concept", False),
    ("figures", "figure", "illustrates", False),
    ("diagrams", "diagram", "illustrates", False),
    ("tables", "table", "illustrates", False),
    ("activities", "activity", "teaches", False),
    ("topics", "topic", "contains", False),
)


def concept_relationships(items: DataFrame) -> DataFrame:
    """Relationship rows of items (registry, item_id, concept_ids) with the concepts they name, in one pass over them.

    Items without an id, null or empty concept ids, and registries that have no relationship give none; a repeated relationship is one.
    """
    kinds = F.array(*(F.struct(F.lit(r).alias("registry"), F.lit(t).alias("item_type"), F.lit(k).alias("type"), F.lit(c).alias("from_concept")) for r, t, k, c in CONCEPT_RELATIONSHIPS))
    each = items.select("registry", F.col("item_id").cast("string").alias("item_id"), F.explode("concept_ids").alias("concept_id")).withColumn("concept_id", F.col("concept_id").cast("string"))
    each = each.where("item_id <> '' and concept_id <> ''").withColumn("k", F.explode(F.filter(kinds, lambda x: x["registry"] == F.col("registry"))))
    pick = lambda a, b: F.when(F.col("k.from_concept"), a).otherwise(b)
    concept = F.lit("concept")
    out = each.select("k.type", pick(concept, F.col("k.item_type")).alias("source_type"), pick(F.col("concept_id"), F.col("item_id")).alias("source_id"), pick(F.col("k.item_type"), concept).alias("target_type"), pick(F.col("item_id"), F.col("concept_id")).alias("target_id")).distinct()
    return out.withColumn("id", make_id(F.concat_ws("_", "type", "source_type", "source_id", "target_type", "target_id")))


def cooccurrence(memberships: DataFrame, group: str, item: str, most: int = 500) -> DataFrame:
    """(a, b, n): in how many groups two items stand together, a < b.

    Pairs are formed inside a group's sorted array, so that the group is shuffled once. Groups of over ``most`` items are
    joined with themselves instead: their arrays would be large, and the join can be split.
    """
    distinct = memberships.select(group, item).distinct()
    sized = distinct.groupBy(group).agg(F.count("*").alias("n"))
    small = distinct.join(sized.where(F.col("n") <= most).select(group), group).groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    a = small.select(F.col("items"), F.posexplode("items").alias("at", "a"))
    pairs = a.select("a", F.explode(F.slice("items", F.col("at") + 2, F.greatest(F.size("items"), F.lit(1)))).alias("b"))
    large = distinct.join(sized.where(F.col("n") > most).select(group), group)
    x, y = large.alias("x"), large.alias("y")
    more = x.join(y, F.col(f"x.{group}") == F.col(f"y.{group}")).where(F.col(f"x.{item}") < F.col(f"y.{item}")).select(F.col(f"x.{item}").alias("a"), F.col(f"y.{item}").alias("b"))
    return pairs.union(more).groupBy("a", "b").agg(F.count("*").alias("n"))


def best_edges(rows: DataFrame, keys: Sequence[str], confidence: str) -> DataFrame:
    """One edge for each key: the surest."""
    return rows.groupBy(*keys).agg(F.max(confidence).alias(confidence), F.count("*").alias("n_merged"))


def edge_confidence(weight: Column, a: Column, b: Column, evidence: Column) -> Column:
    """evidence x weight x (0.5 + 0.5 x mean confidence), held to 0..1, four places; a tie goes up, whatever its last bit."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), evidence * weight * (0.5 + 0.5 * (a + b) / 2))) + 1e-9, 4)


def rule_relationships(anchors: DataFrame, rules: DataFrame, group: str, fallback: tuple[str, str, float], least: float = 0.1) -> DataFrame:
    """Edges between the classes of a group's anchors by their roles, or by the fallback; edges below ``least`` go.

    Anchors of one group, role and confidence are a class, and all of them have the same edges; ``n_edges`` says how many edges
    between anchors a row stands for, and the anchors' own columns say which. So rows grow with the classes and not with the square
    of the anchors. An anchor_id stands once in its group; an anchor has no edge to itself; null groups, roles or confidences give none.
    ``rules`` are few and broadcast. Evidence: 0.4 for a rule, 0.3 for a mean confidence of 0.5 or more, 0.3 for both known.
    """
    classes = anchors.where("role is not null and confidence is not null").groupBy(group, "role", "confidence").agg(F.count("anchor_id").alias("n"))
    s, t = (classes.select(group, F.col("role").alias(f"{x}_role"), F.col("confidence").alias(f"{x}_confidence"), F.col("n").alias(f"{x}_n")) for x in ("source", "target"))
    own = (F.col("source_role") == F.col("target_role")) & (F.col("source_confidence") == F.col("target_confidence"))
    pairs = s.join(t, group).withColumn("n_edges", F.col("source_n") * (F.col("target_n") - own.cast("long"))).where("n_edges > 0")
    pairs = pairs.join(F.broadcast(rules), ["source_role", "target_role"], "left")
    kind, way, weight = fallback
    pairs = pairs.withColumns({"type": F.coalesce("type", F.lit(kind)), "direction": F.coalesce("direction", F.lit(way)), "matched": F.col("weight").isNotNull(), "weight": F.coalesce("weight", F.lit(weight))})
    mean = (F.col("source_confidence") + F.col("target_confidence")) / 2
    evidence = (F.when(F.col("matched"), 4).otherwise(1) + F.when(mean >= 0.5, 3).otherwise(0) + 3) / 10
    return pairs.withColumn("confidence", edge_confidence(F.col("weight"), F.col("source_confidence"), F.col("target_confidence"), evidence)).where(F.col("confidence") >= least).select(group, "source_role", "source_confidence", "target_role", "target_confidence", "type", "direction", "confidence", "n_edges")
