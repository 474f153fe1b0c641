"""Keyed tables: duplicates, lookups, reference resolution and reverse links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def duplicate_keys(table: DataFrame, key: Column) -> DataFrame:
    """Keys that stand in several rows, with the number; null keys are no duplicates."""
    return table.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1 and key is not null")


def first_by_key(table: DataFrame, keys: list[str], order: str, lineage: str) -> DataFrame:
    """One row for each row of ``table``: its keys, the first id of the key, its own id as ``lineage``, and ``n_copies`` of the key.

    Firsts are aggregated before they are shuffled, and a key's rows are never gathered into one: the join may split a hot key.
    Null keys are a key like others; an empty table gives an empty one.
    """
    firsts = table.groupBy(*keys).agg(F.min(order).alias("_first"), F.count("*").alias("n_copies")).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return table.join(firsts, same).select(*keys, F.col("_first").alias(order), F.col(order).alias(lineage), "n_copies")


def unambiguous_lookup(names: DataFrame, key: str, target: str) -> DataFrame:
    """key -> target, without the keys that several targets own."""
    return names.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(target).alias(target), F.count_distinct(target).alias("owners")).where("owners = 1").drop("owners")


def resolve(rows: DataFrame, term: Column, lookup: DataFrame, key: str, target: str) -> DataFrame:
    """``rows`` with the target of their term and a status; a term without a target is unresolved, a null one not applicable."""
    asked = rows.withColumn("term_key", term)
    found = asked.join(lookup.withColumnsRenamed({key: "term_key"}), "term_key", "left")
    status = F.when(F.col("term_key").isNull(), "not_applicable").when(F.col(target).isNull(), "unresolved").otherwise("resolved")
    return found.withColumn("status", status)


def reverse_links(links: DataFrame, target: str, kind: str, source: str) -> DataFrame:
    """(target, kind, source), each once; a target's sources are rows, so that a target with very many is no large row. Null sources give none."""
    return links.where(F.col(source).isNotNull()).select(target, kind, source).distinct()


def union_counts(tables: dict[str, DataFrame], key: dict[str, str]) -> DataFrame:
    """Rows and distinct keys of each registry."""
    out = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("registry"), F.col(key[name]).cast("string").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("registry").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
