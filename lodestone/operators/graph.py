"""Closure, depth, paths, components and order of graphs given as edge tables.

Each iteration writes its frontier to the folder in spark.checkpoint.dir, so that neither lineage nor memory grows with the
rounds. Rounds go on until nothing is new or moves, which finite graphs reach, with cycles too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def union_of(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, node) for all paths of one edge or more; pairs that are known are not followed again.

    ``edges``: (source, target). A node on a cycle is its own ancestor. Rounds go over the edges between nodes that have edges
    of their own; edges to the others, which end every path, are joined once behind them.
    """
    step = kept(edges.select("source", "target").distinct())
    sources = kept(step.select("source").distinct()).select(F.col("source").alias("target"))
    inner = kept(step.join(sources, "target", "left_semi").select("source", "target"))
    last = step.join(sources, "target", "left_anti").select("source", "target")
    frontier = inner.select(F.col("source").alias("ancestor"), F.col("target").alias("node"))
    seen = [frontier]
    while not frontier.isEmpty():
        new = frontier.join(inner, frontier["node"] == inner["source"]).select("ancestor", F.col("target").alias("node")).distinct()
        frontier = kept(new.join(union_of(seen), ["ancestor", "node"], "left_anti"))
        seen.append(frontier)
    known = union_of(seen)
    behind = known.join(last, known["node"] == last["source"]).select("ancestor", F.col("target").alias("node"))
    return known.unionByName(last.select(F.col("source").alias("ancestor"), F.col("target").alias("node")).unionByName(behind).distinct())


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes from which a changed node is reached (source depends on target), without the changed ones."""
    step = kept(edges.select("source", "target").distinct())
    start = frontier = kept(changed.select("node").distinct())
    seen = [start]
    while True:
        new = frontier.join(step, frontier["node"] == step["target"]).select(F.col("source").alias("node")).distinct()
        frontier = kept(new.join(union_of(seen), "node", "left_anti"))
        if frontier.isEmpty():
            return union_of([start.limit(0), *seen[1:]])
        seen.append(frontier)


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): the longest path from a node without incoming edges; null for nodes on or behind a cycle.

    Each round settles the nodes whose sources are all settled: an order that runs a level at a time.
    """
    e = kept(edges.select("source", "target").distinct())
    todo = kept(nodes.select("node").distinct())
    done: list[DataFrame] = []
    level = 0
    while True:
        waiting = e.join(todo.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        ready = kept(todo.join(waiting, "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done.append(ready)
        todo = kept(todo.join(ready.select("node"), "node", "left_anti"))
        level += 1
    return union_of([*done, todo.withColumn("level", F.lit(None).cast("int"))])


def _hot(rows: DataFrame, column: str) -> list:
    """Values that a thousandth of the rows or more have, and some others: under a thousand in all."""
    return [x for x in rows.stat.freqItems([column], 0.001).first()[0] if x is not None]


def _starred(pairs: DataFrame, hot: list) -> DataFrame:
    """(node, other) pairs with the same components: each group of pairs with one ``node`` is hung on its least ``other``.

    Groups of the ``hot`` nodes are hung in 64 shares, so that no task gets all pairs of one node.
    """
    share = F.when(F.col("node").isin(hot), F.pmod(F.xxhash64("other"), F.lit(64))).otherwise(0) if hot else F.lit(0)
    least = pairs.withColumn("share", share).withColumn("hub", F.min("other").over(Window.partitionBy("node", "share")))
    hung = F.array(F.struct(F.col("other").alias("node"), F.col("hub").alias("other")), F.when(F.col("other").eqNullSafe(F.col("hub")), F.struct("node", F.col("hub").alias("other"))))
    return least.select(F.inline(F.array_compact(hung)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is linked, directly or not. Labels jump to their label's label in each round.

    Edges first become stars about the least source of each target, then about the least of these for each node: what is
    left is about as many edges as nodes, and the rounds go over these.
    """
    ends = F.when(F.col("source").isNotNull() & F.col("target").isNotNull(), F.array(F.struct(F.col("target").alias("node"), F.col("source").alias("other"))))
    alone = F.array(F.struct(F.col("source").alias("node"), F.col("source").alias("other")), F.struct(F.col("target").alias("node"), F.col("target").alias("other")))
    given = kept(edges.select(F.inline(F.coalesce(ends, alone))))
    few = kept(_starred(_starred(given, _hot(given, "node")), _hot(given, "other")).distinct())
    both = few.union(few.select(F.col("other"), F.col("node"))).distinct()
    both = kept(both)
    label = kept(both.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        seen = both.join(label.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        low = label.join(seen, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = low.join(low.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = kept(jump)
        moved = jump.join(label.withColumnRenamed("component", "old"), "node").where("component <> old")
        label = jump
        if moved.isEmpty():
            break
    return label


def paths(parents: DataFrame) -> DataFrame:
    """(node, path) from the root down, for rows (node, parent); a repeated node ends the walk."""
    up = kept(parents.select("node", "parent"))
    walk = up.select("node", F.array("node").alias("path"), F.col("parent").alias("next"))
    while True:
        joined = walk.join(up.select(F.col("node").alias("next"), F.col("parent").alias("above")), "next", "left")
        fresh = F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))
        walk = kept(joined.select("node", F.when(fresh, F.concat(F.array("next"), "path")).otherwise(F.col("path")).alias("path"), F.when(fresh, F.col("above")).alias("next")))
        if walk.where("next is not null").isEmpty():
            break
    return walk.select("node", "path")


def shortest_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, path): of the shortest paths from any root (node) the least, as an array; nodes that none reaches are left out.

    Breadth first: a level's paths of equal length are compared before the next one is looked at.
    """
    step = kept(edges.select("source", "target").distinct())
    frontier = kept(roots.select("node", F.array("node").alias("path")).distinct())
    seen = [frontier]
    while True:
        new = frontier.join(step, frontier["node"] == step["source"]).select(F.col("target").alias("node"), F.array_append("path", F.col("target")).alias("path"))
        frontier = kept(new.groupBy("node").agg(F.min("path").alias("path")).join(union_of(seen).select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            return union_of(seen)
        seen.append(frontier)
