"""Statistics of graphs and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree, is_hub): a hub has a degree over the mean plus one population deviation; nodes without edges have 0."""
    ends = edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node")))
    n = ends.groupBy("node").agg(F.count("*").alias("degree"))
    all_nodes = nodes.select("node").join(n, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    limit = all_nodes.agg((F.avg("degree") + F.stddev_pop("degree")).alias("limit"))
    return all_nodes.crossJoin(F.broadcast(limit)).select("node", "degree", (F.col("degree") > F.col("limit")).alias("is_hub"))  # the limit is one row


def graph_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, density over n(n-1), orphan ratio (four places)."""
    linked = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    n, e = nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    o = nodes.select("node").join(linked, "node", "left_anti").agg(F.count("*").alias("n_orphans"))
    all_three = n.crossJoin(e).crossJoin(o)  # one row each
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))
    return all_three.select("n_nodes", "n_edges", "n_orphans", ratio(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)).alias("density"), ratio(F.col("n_orphans"), F.col("n_nodes")).alias("orphan_ratio"))


def completeness(checks: dict[str, tuple[Column, int]]) -> Column:
    """Share of the weights whose check holds, four places."""
    total = sum(w for _, w in checks.values())
    got = sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0) for c, w in checks.values()), F.lit(0))
    return F.round(got / total, 4)


def mode_weighted(rows: DataFrame, group: str, value: str, weight: Column) -> DataFrame:
    """The value with the most weight in each group; the greatest value wins ties."""
    n = rows.groupBy(group, value).agg(F.sum(weight).alias("weight"))
    return n.groupBy(group).agg(F.max(F.struct("weight", value)).alias("top")).select(group, F.col(f"top.{value}").alias("mode"), F.col("top.weight").alias("weight"))


def inverted_index(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item), each posting once as a row of its own, so that a frequent key is no large row; null keys and items give none."""
    return rows.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(key, item).distinct()


def block_fingerprints(rows: DataFrame, group: str, order: str, text: Column, block: int = 4096) -> DataFrame:
    """One sha256 for each group: over blocks of ``block`` neighbouring keys, over blocks of those, and over what is left.

    ``order`` is a whole-number key that is unique within its group, so that no array is longer than ``block`` but the last,
    which has a hash for each ``block`` x ``block`` keys.
    """
    at = F.col("_at")
    joined = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda r: r["_text"]), ";"), 256)
    level = rows.select(group, F.col(order).alias("_at"), text.alias("_text"))
    for _ in range(2):
        level = level.groupBy(group, F.floor(at / block).alias("_next")).agg(joined().alias("_text")).withColumnRenamed("_next", "_at")
    return level.groupBy(group).agg(joined().alias("fingerprint"))


def by_confidence(rows: DataFrame, kind: str, confidence: str) -> DataFrame:
    """Number and average, least and greatest confidence of each kind (four places)."""
    c = F.col(confidence)
    return rows.groupBy(kind).agg(F.count("*").alias("n"), F.round(F.avg(c), 4).alias("avg_confidence"), F.round(F.min(c), 4).alias("min_confidence"), F.round(F.max(c), 4).alias("max_confidence"))
