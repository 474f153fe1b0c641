"""Range, band, nearest and as-of joins, each over an equi-join on a bucket or a key so that no pair of all rows is formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_link(points: DataFrame, point: str, spans: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Points joined with the spans that contain them (both ends included).

    A span is put into each bucket of ``width`` that it touches, so that a point meets only the spans of its own bucket.
    """
    b = lambda c: F.floor(F.col(c) / width)
    placed = spans.withColumn("bucket", F.explode(F.sequence(b(start), b(end))))
    return points.withColumn("bucket", b(point)).join(placed, "bucket").where(F.col(point).between(F.col(start), F.col(end))).drop("bucket")


def range_tally(points: DataFrame, key: str, point: str, spans: DataFrame, span: str, start: str, end: str, width: float) -> DataFrame:
    """(key, span, n_spans): for each point that spans contain the largest span and their number.

    Equal spans are counted first and met once, so work follows the points and the different spans, not the pairs.
    """
    once = spans.groupBy(start, end).agg(F.max(span).alias(span), F.count("*").alias("n_spans"))
    joined = range_link(points, point, once, start, end, width)
    return joined.groupBy(key).agg(F.max(span).alias(span), F.sum("n_spans").alias("n_spans"))


def last_match(joined: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return joined.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("nth = 1").drop("nth")


def band_neighbours(rows: DataFrame, group: str, position: str, item: str, reach: int) -> DataFrame:
    """Pairs of items of a group whose positions differ by ``reach`` at most: each row goes to the positions it reaches."""
    other = rows.select(F.col(group), F.explode(F.sequence(F.col(position) - reach, F.col(position) + reach)).alias(position), F.col(item).alias("near"), F.col(position).alias("near_position"))
    return rows.select(group, position, item).join(other, [group, position]).where(F.col("near") != F.col(item))


def as_of(events: DataFrame, facts: DataFrame, key: str, at: str, since: str, value: str, strict: bool = True) -> DataFrame:
    """The latest fact of the same key before each event (strictly, or up to its moment): one sort, no pair of rows is formed."""
    e = events.withColumns({"_side": F.lit(0 if strict else 1), "_at": F.col(at), "_fact": F.lit(None).cast(facts.schema[value].dataType)})
    f = facts.select(F.col(key), F.col(since).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.col(value).alias("_fact"), F.lit(True).alias("_is_fact"))
    both = e.withColumn("_is_fact", F.lit(False)).unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("previous", F.last("_fact", ignorenulls=True).over(w)).where("not _is_fact").drop("_side", "_at", "_fact", "_is_fact")


def nearest(rows: DataFrame, others: DataFrame, group: str, at: str, other_at: str, other_id: str, most: float) -> DataFrame:
    """The nearest other row of the group within ``most``; the smaller id wins ties. Others go to the buckets next to theirs."""
    b = lambda c: F.floor(F.col(c) / most)
    o = others.select(F.col(group), F.col(other_at), F.col(other_id), F.explode(F.sequence(b(other_at) - 1, b(other_at) + 1)).alias("bucket"))
    pairs = rows.withColumns({"bucket": b(at), "row": F.monotonically_increasing_id()}).join(o, [group, "bucket"]).withColumn("distance", F.abs(F.col(at) - F.col(other_at))).where(F.col("distance") <= most)
    return pairs.groupBy("row", *rows.columns).agg(F.min(F.struct("distance", other_id)).alias("best")).select(*rows.columns, f"best.{other_id}", "best.distance")
