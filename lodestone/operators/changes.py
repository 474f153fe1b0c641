"""Snapshots of fingerprints: differences, streaks, earlier snapshots and rebuild plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(artifact, change) for two tables (artifact, fingerprint): added, removed, modified or unchanged."""
    o = old.select("artifact", F.col("fingerprint").alias("before"))
    both = o.join(new.select("artifact", F.col("fingerprint").alias("after")), "artifact", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified").otherwise("unchanged")
    return both.select("artifact", change.alias("change"))


def streaks(snapshots: DataFrame) -> DataFrame:
    """(artifact, n_builds, n_changes, longest) over (artifact, build_id, fingerprint): the longest run of builds without a change."""
    w = Window.partitionBy("artifact").orderBy("build_id")
    moved = snapshots.withColumn("moved", F.coalesce((F.col("fingerprint") != F.lag("fingerprint").over(w)).cast("int"), F.lit(0)))
    runs = moved.withColumn("run", F.sum("moved").over(w)).groupBy("artifact", "run").agg(F.count("*").alias("length"))
    return runs.groupBy("artifact").agg(F.sum("length").alias("n_builds"), (F.count("*") - 1).alias("n_changes"), F.max("length").alias("longest"))


def churn(snapshots: DataFrame) -> DataFrame:
    """(build_id, n_artifacts, n_moved): artifacts of each build that differ from their previous build."""
    w = Window.partitionBy("artifact").orderBy("build_id")
    moved = snapshots.withColumn("moved", F.coalesce((F.col("fingerprint") != F.lag("fingerprint").over(w)).cast("int"), F.lit(0)))
    return moved.groupBy("build_id").agg(F.count("*").alias("n_artifacts"), F.sum("moved").alias("n_moved"))


def rebuild_plan(changes: DataFrame, affected: DataFrame) -> DataFrame:
    """(artifact, reason): what is added or modified, and what depends on it."""
    dirty = changes.where(F.col("change").isin("added", "modified")).select("artifact", F.concat(F.lit("source_"), F.col("change")).alias("reason"))
    behind = affected.select(F.col("node").alias("artifact")).join(dirty.select("artifact"), "artifact", "left_anti").withColumn("reason", F.lit("dependency_changed"))
    return dirty.unionByName(behind)
