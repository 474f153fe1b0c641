"""Point and batch lookups over resource tables in long form: one row for each item of a concept.

A resource table has (concept_id, kind, ord, item_id) and more columns. Asking for one concept is a filter that reaches the
scan; asking for many is a join with the ids. Ids that nothing has give no rows; null ids match nothing; repeated ids are
asked for once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def by_key(table: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows of ``table`` whose key is among the ids."""
    return table.join(ids.select(F.col(id_column).alias(key)).distinct(), key)


def items(resources: DataFrame, ids: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Items of the concepts, kind after kind in the order given, then by ``ord``, numbered from 1."""
    asked = by_key(resources.where(F.col("kind").isin(*kinds)), "concept_id", ids, "concept_id")
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    return asked.withColumn("nth", F.row_number().over(Window.partitionBy("concept_id").orderBy(place, "ord", "item_id")))


def first_distinct(rows: DataFrame, group: str, item: str, order: Sequence[str]) -> DataFrame:
    """The first row of each item of a group, in order, numbered anew."""
    once = rows.withColumn("_seen", F.row_number().over(Window.partitionBy(group, item).orderBy(*order))).where("_seen = 1").drop("_seen")
    return once.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def best_by(rows: DataFrame, group: str, order: Sequence[Column | str]) -> DataFrame:
    """The least row of each group by ``order``, through partial aggregation."""
    least = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])
    return rows.groupBy(group).agg(F.min_by(F.struct(*[c for c in rows.columns if c != group]), least).alias("best")).select(group, "best.*")


def in_order(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``rows`` with ``position`` from 0 over the whole order: ranks within ranges of it and the sizes of the ranges before."""
    placed = kept(rows.repartitionByRange(*[c if isinstance(c, Column) else F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()))
    n = placed.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return placed.withColumn("_nth", nth).join(n.drop("_n"), "_range").withColumn("position", F.col("_nth") + F.col("_before")).drop("_nth", "_before", "_range")


def field_of_stage(stages: dict[str, Column], stage: Column) -> Column:
    """The template's value for a stage, null for an unknown one."""
    out = F.lit(None)
    for name, value in stages.items():
        out = F.when(stage == name, value).otherwise(out)
    return out
