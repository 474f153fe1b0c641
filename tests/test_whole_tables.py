"""Queries over whole tables against brute force: rows that the filtered queries leave out count too."""

from __future__ import annotations

import random

from lodestone.plans import graph_plans, object_plans, text_plans


def test_components_of_all_orders(spark):
    rng = random.Random(5)
    orders = [(k, rng.randrange(40)) for k in range(1, 61)]  # no key is a multiple of 97
    lines = [(k, rng.randrange(80)) for k, _ in orders for _ in range(2)]
    frames = {"orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long"), "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long")}
    root: dict[str, str] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    customer = dict(orders)
    for k, part in lines:
        a, b = sorted((find(f"c{customer[k]}"), find(f"p{part}")))
        root[b] = a
    got = {r.node: r.component for r in graph_plans.components(frames.get).collect()}
    assert got == {x: find(x) for x in list(root)} and len(set(got.values())) > 1


def test_edges_of_later_lines(spark):
    """A supplier's part and a changed part that stand in second lines only."""
    frames = {
        "nation": spark.createDataFrame([(7, 1)], "n_nationkey long, n_regionkey long"),
        "supplier": spark.createDataFrame([(5, 7), (6, 7)], "s_suppkey long, s_nationkey long"),
        "lineitem": spark.createDataFrame([(1, 1, 5, 9), (1, 2, 6, 1), (2, 2, 6, 8)], "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long"),
    }
    below = {r.ancestor: (r.n_below, r.first_below) for r in graph_plans.transitive_prereqs(frames.get).collect()}
    assert below == {"r1": (6, "n7"), "n7": (5, "p1"), "s5": (1, "p9"), "s6": (2, "p1")}
    assert {r.node: r.level for r in graph_plans.max_depth(frames.get).collect()} == {"r1": 0, "n7": 1, "s5": 2, "s6": 2, "p9": 3, "p1": 3, "p8": 3}
    assert {r.node for r in graph_plans.affected_closure(frames.get).collect()} == {"s6", "n7", "r1"}


def test_formulas_of_all_lines(spark):
    lines = spark.createDataFrame([(1, k, 17, 9, 50.0, 0.0, 0.0, "O") for k in range(1, 8)], "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long, l_quantity double, l_discount double, l_tax double, l_linestatus string")
    t = {"lineitem": lines}.get
    each = {(1, k) for k in range(1, 8)}
    assert {(r.l_orderkey, r.l_linenumber) for r in text_plans.number_depth(t).where("depth = 3").collect()} == each
    assert {(r.l_orderkey, r.l_linenumber) for r in object_plans.structural_confidence(t).where("structural = 1").collect()} == each
    assert {(r.l_orderkey, r.l_linenumber) for r in object_plans.stage_minutes(t).where("s1 = 7.5 and s2 = 12.5 and s3 = 15").collect()} == each
