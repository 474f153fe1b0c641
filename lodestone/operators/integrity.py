"""Integrity rules: each is a query that gives issue rows (rule, severity, object_id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import affected


def issues(rows: DataFrame, rule: str, severity: str, object_id: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), object_id.cast("string").alias("object_id"), detail.cast("string").alias("detail"))


def duplicate_id(table: DataFrame, key: str, rule: str) -> DataFrame:
    found = table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return issues(found, rule, "ERROR", F.col(key), F.col("n"))


def missing_field(table: DataFrame, key: str, field: str, rule: str) -> DataFrame:
    return issues(table.where(F.col(field).isNull() | (F.trim(F.col(field).cast("string")) == "")), rule, "ERROR", F.col(key), F.lit(field))


def broken_reference(table: DataFrame, key: str, field: str, target: DataFrame, target_key: str, rule: str) -> DataFrame:
    t = target.select(F.col(target_key).alias(field)).distinct()
    return issues(table.where(F.col(field).isNotNull()).join(t, field, "left_anti"), rule, "ERROR", F.col(key), F.col(field))


def out_of_range(table: DataFrame, key: str, ok: Column, detail: Column, rule: str, severity: str = "WARNING") -> DataFrame:
    return issues(table.where(~F.coalesce(ok, F.lit(False))), rule, severity, F.col(key), detail)


def unowned(table: DataFrame, key: str, owners: DataFrame, field: str, rule: str) -> DataFrame:
    """Rows that no owner refers to, or several do: each must have exactly one."""
    n = owners.groupBy(F.col(field).alias(key)).agg(F.count("*").alias("n"))
    found = table.select(key).join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")
    return issues(found, rule, "WARNING", F.col(key), F.col("n"))


def reverse_mismatch(forward: DataFrame, backward: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Pairs that only one of two tables of links has."""
    f, b = forward.select(*keys).distinct(), backward.select(*keys).distinct()
    one = lambda df, side: issues(df, rule, "WARNING", F.col(keys[0]), F.concat(F.lit(side + ":"), F.col(keys[1]).cast("string")))
    return one(f.join(b, keys, "left_anti"), "no_reverse").unionByName(one(b.join(f, keys, "left_anti"), "no_forward"))


def all_issues(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def quality_score(found: DataFrame, n_objects: int) -> DataFrame:
    """Issues by severity, and 1 minus the share of objects that have any."""
    return found.groupBy("severity").agg(F.count("*").alias("n_issues"), F.round(1 - F.count_distinct("object_id") / F.lit(max(1, n_objects)), 4).alias("score"))


def span_outside(nodes: DataFrame, rule: str) -> DataFrame:
    """Nodes (node, parent, span_start, span_end) that reach beyond their parent's span."""
    p = nodes.select(F.col("node").alias("parent"), F.col("span_start").alias("from_"), F.col("span_end").alias("to_"))
    found = nodes.join(p, "parent").where("span_start < from_ or span_end > to_")
    return issues(found, rule, "ERROR", F.col("node"), F.concat_ws("-", "span_start", "span_end"))


def unreachable(nodes: DataFrame, root: str, rule: str) -> DataFrame:
    """Nodes (node, parent) that no path from the root reaches."""
    start = nodes.where(F.col("node") == root).select("node")
    below = affected(nodes.select(F.col("node").alias("source"), F.col("parent").alias("target")).where("target is not null"), start)
    return issues(nodes.select("node", "parent").join(below.union(start), "node", "left_anti"), rule, "ERROR", F.col("node"), F.col("parent"))


def duplicate_entry(rows: DataFrame, group: str, entry: str, rule: str) -> DataFrame:
    """Entries that stand several times in one sequence."""
    found = rows.groupBy(group, entry).agg(F.count("*").alias("n")).where("n > 1")
    return issues(found, rule, "ERROR", F.col(group), F.concat_ws(" x", entry, "n"))


def declared_differs(nodes: DataFrame, declared: DataFrame, rule: str) -> DataFrame:
    """Pairs (parent, node) that are declared but not there, or there but not declared."""
    d, a = declared.select("parent", "node").distinct(), nodes.where("parent is not null").select("parent", "node").distinct()
    one = lambda x, y, side: issues(x.join(y, ["parent", "node"], "left_anti"), rule, "ERROR", F.col("parent"), F.concat(F.lit(side + ":"), F.col("node")))
    return one(d, a, "declared").unionByName(one(a, d, "actual"))


def not_recomputable(rows: DataFrame, key: str, stored: Column, computed: Column, rule: str) -> DataFrame:
    """Rows whose stored value is not what its parts give; two nulls agree."""
    return issues(rows.where(~stored.eqNullSafe(computed)), rule, "ERROR", F.col(key), stored)


def type_differs(refs: DataFrame, key: str, ref: str, kind: str, registry: DataFrame, registry_key: str, registry_kind: str, rule: str) -> DataFrame:
    """References whose stated type is not that of what they refer to; broken ones are another rule's."""
    r = registry.select(F.col(registry_key).alias(ref), F.col(registry_kind).alias("is_kind"))
    return issues(refs.join(r, ref).where(~F.col(kind).eqNullSafe(F.col("is_kind"))), rule, "ERROR", F.col(key), F.concat_ws("/", kind, "is_kind"))


def misordered(edges: DataFrame, positions: DataFrame, rule: str) -> DataFrame:
    """Edges (source depends on target) whose target does not come before its source; ``positions``: (node, position)."""
    at = lambda end: positions.select(F.col("node").alias(end), F.col("position").alias(f"{end}_at"))
    found = edges.join(at("source"), "source").join(at("target"), "target").where("target_at >= source_at")
    return issues(found, rule, "ERROR", F.col("source"), F.col("target"))


def shape_differs(table: DataFrame, key: str, field: str, pattern: str, rule: str) -> DataFrame:
    """Values that are there but do not have their shape."""
    return issues(table.where(F.col(field).isNotNull() & ~F.col(field).rlike(pattern)), rule, "ERROR", F.col(key), F.col(field))


def outside_vocabulary(table: DataFrame, key: str, field: str, vocabulary: list[str], rule: str) -> DataFrame:
    """Values outside a closed vocabulary, null among them."""
    return issues(table.where(~F.coalesce(F.col(field).isin(*vocabulary), F.lit(False))), rule, "WARNING", F.col(key), F.coalesce(F.col(field), F.lit("null")))


def too_wordy(table: DataFrame, key: str, text: str, most: int, rule: str) -> DataFrame:
    """Texts of more words than a field may hold."""
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    return issues(table.withColumn("_n", n).where(F.col("_n") > most), rule, "WARNING", F.col(key), F.col("_n"))


def absent(present: DataFrame, name: str, required: list[str], rule: str) -> DataFrame:
    """Required names that a table does not have."""
    asked = present.sparkSession.createDataFrame([(r,) for r in required], f"{name} string")
    return issues(asked.join(present.select(name).distinct(), name, "left_anti"), rule, "ERROR", F.col(name), F.lit("absent"))


def level_differs(rows: DataFrame, key: str, score: Column, level: Column, rule: str) -> DataFrame:
    """Rows whose level is not the one that their score gives (high from 0.75, medium from 0.4)."""
    want = F.when(score >= 0.75, "high").when(score >= 0.4, "medium").when(score.isNotNull(), "low")
    return issues(rows.where(~level.eqNullSafe(want)), rule, "WARNING", F.col(key), level)
