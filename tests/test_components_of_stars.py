"""Components through stars: few edges are left, and the components are those of the edges given."""

import random

from pyspark.sql import functions as F

from lodestone.operators import graph as G


def by_hand(edges):
    up = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {(x, root(x)) for x in up} | ({(None, None)} if any(None in e for e in edges) else set())


def test_random_graphs_with_loops_nulls_and_hubs(spark):
    r = random.Random(5)
    name = lambda n: r.choice([*(f"n{r.randrange(n)}" for _ in range(30)), None, "hub"])
    edges = [(name(80), name(80)) for _ in range(70)] + [("hub", "hub"), ("x", None), ("y", "y")]
    found = G.components(spark.createDataFrame(edges, "source string, target string"))
    assert {(x.node, x.component) for x in found.collect()} == by_hand(edges)
    assert found.count() == len(by_hand(edges))


def test_dense_edges_become_about_as_many_as_nodes(spark):
    dense = spark.range(300).select(F.concat(F.lit("c"), "id").alias("other")).crossJoin(spark.range(300).select(F.concat(F.lit("p"), "id").alias("node"))).select("node", "other")
    for hot in ([], ["p1", "c1"]):
        assert G._starred(G._starred(dense, hot), hot).distinct().count() < 1500
