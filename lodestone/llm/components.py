"""Connected components of links by alternating stars: in each round nodes hang themselves onto the smallest node they see.

Only links and their minima are shuffled (aggregated before the shuffle; links of hubs stay where they are); nothing comes to the
driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, skew_join


#: Up to so many links, all of them are a task's worth, and a hub's cannot be too many for one.
ONE_TASK = 100_000


def _with_least(rows: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    return skew_join(rows, materialise(least, "least"), "u") if hubs else rows.join(least, "u")


def _large_star(e: DataFrame, hubs: bool) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both, least, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, hubs: bool) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(e, least, hubs).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that has a link; a component is named by its smallest node.

    Links go either way and may repeat; a link of a node to itself, or with a null end, says nothing.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e, before = materialise(e, "links"), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        hubs = state[0] > ONE_TASK
        large = _large_star(e, hubs)
        e = materialise(_small_star(materialise(large, "large") if hubs else large, hubs), "stars")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
