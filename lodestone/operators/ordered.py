"""Operators on ordered rows: neighbours, gaps, runs, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precedes(rows: DataFrame, group: str, position: str, item: str) -> DataFrame:
    """An edge from each item to the next of its group."""
    w = Window.partitionBy(group).orderBy(position, item)
    return rows.select(group, F.col(item).alias("source"), F.lead(item).over(w).alias("target")).where("target is not null")


def siblings(rows: DataFrame, parent: str, order: str, item: str) -> DataFrame:
    """Each item with the ones before and after it under its parent, and its ordinal from 1."""
    w = Window.partitionBy(parent).orderBy(order)
    return rows.select(parent, item, F.lag(item).over(w).alias("previous"), F.lead(item).over(w).alias("next"), F.row_number().over(w).alias("ordinal"))


def gap_clusters(rows: DataFrame, group: str, at: str, gap: float) -> DataFrame:
    """``rows`` with the number of their cluster: a new one begins where the gap to the row before is over ``gap``."""
    w = Window.partitionBy(group).orderBy(at)
    begins = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    return rows.withColumn("begins", F.coalesce(begins, F.lit(0))).withColumn("cluster", F.sum("begins").over(w)).drop("begins")


def sequence_breaks(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Rows whose number repeats, falls or skips after the one before."""
    w = Window.partitionBy(group).orderBy(number)
    step = F.col(number) - F.lag(number).over(w)
    kind = F.when(step == 0, "duplicate").when(step < 0, "decreasing").when(step > 1, "skipped")
    return rows.withColumn("break_kind", kind).where("break_kind is not null")


def within_budget(rows: DataFrame, group: str, order: list, cost: str, budget: float) -> DataFrame:
    """Rows of each group in order while their running cost stays within the budget; the first always."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = rows.withColumns({"nth": F.row_number().over(w), "running": F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.where((F.col("running") <= budget) | (F.col("nth") == 1))


def until_next_label(rows: DataFrame, group: str, position: str, is_label, text: str, most: int) -> DataFrame:
    """Each label row with the texts of up to ``most`` rows after it, up to the next label."""
    w = Window.partitionBy(group).orderBy(position)
    marked = rows.withColumn("label", is_label.cast("int")).withColumn("block", F.sum("label").over(w)).where("block > 0")
    inside = marked.withColumn("nth", F.row_number().over(Window.partitionBy(group, "block").orderBy(position))).where(F.col("nth") <= most + 1)
    return inside.groupBy(group, "block").agg(F.min(position).alias("label_at"), (F.count("*") - 1).alias("n_body"), F.sum(F.when(F.col("nth") > 1, F.length(text))).alias("body_chars"))


def merged_runs(rows: DataFrame, group: str, position: str, text: str, continues) -> DataFrame:
    """(group, block, first position, n_lines, text): each row that ``continues`` holds for joins the one before, whose text it may look at as ``before``."""
    w = Window.partitionBy(group).orderBy(position)
    seen = rows.withColumn("before", F.lag(text).over(w))
    marked = seen.withColumn("block", F.sum(F.when(F.col("before").isNotNull() & F.coalesce(continues, F.lit(False)), 0).otherwise(1)).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t")))), lambda r: r["t"])
    return marked.groupBy(group, "block").agg(F.min(position).alias("first_line"), F.count("*").alias("n_lines"), F.array_join(parts, " ").alias("text"))
