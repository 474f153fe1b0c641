"""Operators on small tables: cycles, ties, empty tables, missing ends."""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from lodestone.operators import analytics, changes, graph, linking, ordered, registry, relations

CONCEPTS = {"c1": [], "c2": ["c1"], "c3": ["c2"], "c4": ["c3"], "c5": ["c1"], "c6": ["c4", "c5"], "c7": ["c6"], "c8": ["c4"], "c9": ["c8"], "c10": ["c7"], "c11": ["c7"], "c12": ["c10", "c11"]}
EDGES = [(p, c) for c, ps in CONCEPTS.items() for p in ps]


def edges(spark, rows):
    return spark.createDataFrame(rows, "source string, target string")


def test_longest_path_and_closure(spark):
    e = edges(spark, EDGES)
    level = {r.node: r.level for r in graph.levels(e, spark.createDataFrame([(c,) for c in CONCEPTS], "node string")).collect()}
    assert level["c12"] == 7 and level["c1"] == 0
    above = {r.ancestor for r in graph.closure(e).where("node = 'c6'").collect()}
    assert above == {"c1", "c2", "c3", "c4", "c5"}


def test_cycles_end(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")])
    assert {(r.ancestor, r.node) for r in graph.closure(e).collect()} >= {("a", "a"), ("d", "c")}
    level = {r.node: r.level for r in graph.levels(e, spark.createDataFrame([(x,) for x in "abcd"], "node string")).collect()}
    assert level == {"a": None, "b": None, "c": None, "d": 0}
    up = spark.createDataFrame([("a", "b"), ("b", "a"), ("r", None)], "node string, parent string")
    assert {r.node: r.path for r in graph.paths(up).collect()} == {"a": ["b", "a"], "b": ["a", "b"], "r": ["r"]}


def test_components_and_affected(spark):
    e = edges(spark, [("a", "b"), ("c", "b"), ("x", "y")])
    assert {r.node: r.component for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert [r.node for r in graph.affected(edges(spark, [("a", "b")]), spark.createDataFrame([("b",)], "node string")).collect()] == ["a"]
    assert graph.components(edges(spark, [])).count() == 0


def test_deep_paths_and_chains(spark):
    up = spark.createDataFrame([(k, k - 1 if k else None) for k in range(24)], "node int, parent int")
    assert {r.node: r.path for r in graph.paths(up).collect()} == {k: list(range(k + 1)) for k in range(24)}
    e = edges(spark, [(f"n{k}", f"n{k + 1}") for k in range(36)])
    assert graph.affected(e, spark.createDataFrame([("n36",)], "node string")).count() == 36


def test_diff(spark):
    old, new = (spark.createDataFrame(x, "artifact string, fingerprint string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]))
    assert {r.artifact: r.change for r in changes.diff(old, new).collect()} == {"a": "unchanged", "b": "modified", "c": "removed", "d": "added"}


def test_ambiguous_names_go(spark):
    names = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1"), ("y", "1"), (None, "3")], "k string, id string")
    assert [tuple(r) for r in registry.unambiguous_lookup(names, "k", "id").collect()] == [("y", "1")]


def test_as_of_is_strict_or_not(spark):
    e = spark.createDataFrame([(1, 10), (1, 5), (2, 10)], "k int, at int")
    f = spark.createDataFrame([(1, 5, "x"), (1, 10, "y")], "k int, since int, v string")
    strict = {(r.k, r.at): r.previous for r in linking.as_of(e, f, "k", "at", "since", "v").collect()}
    loose = {(r.k, r.at): r.previous for r in linking.as_of(e, f, "k", "at", "since", "v", strict=False).collect()}
    assert strict == {(1, 5): None, (1, 10): "x", (2, 10): None}
    assert loose == {(1, 5): "x", (1, 10): "y", (2, 10): None}


def test_cooccurrence_joins_large_groups_too(spark):
    rows = spark.createDataFrame([(g, i) for g in range(3) for i in range(g, 6)], "g int, i int")
    small, large = ({(r.a, r.b): r.n for r in relations.cooccurrence(rows, "g", "i", most).collect()} for most in (500, 1))
    assert small == large and small[(4, 5)] == 3 and small[(0, 1)] == 1


def test_budget_keeps_the_first(spark):
    rows = spark.createDataFrame([("a", 1, 99), ("a", 2, 1), ("b", 1, 4), ("b", 2, 4), ("b", 3, 4)], "g string, o int, cost int")
    got = {(r.g, r.o) for r in ordered.within_budget(rows, "g", [F.col("o")], "cost", 8).collect()}
    assert got == {("a", 1), ("b", 1), ("b", 2)}


def test_copies_point_to_the_first(spark):
    rows = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2), (None, 5), (None, 4), ("x", 1)], "k string, id int")
    got = sorted(tuple(r) for r in registry.first_by_key(rows, ["k"], "id", "copy").na.fill("-", ["k"]).collect())
    assert got == [("-", 4, 4, 2), ("-", 4, 5, 2), ("x", 1, 1, 3), ("x", 1, 1, 3), ("x", 1, 3, 3), ("y", 2, 2, 1)]
    assert registry.first_by_key(rows.limit(0), ["k"], "id", "copy").count() == 0


def test_blocks_of_fingerprints(spark):
    sha = lambda parts: hashlib.sha256(";".join(parts).encode()).hexdigest()
    rows = spark.createDataFrame([(g, i, f"t{i}") for g, n in (("a", 9), ("b", 1)) for i in range(n)], "g string, i long, t string")
    got = {r.g: r.fingerprint for r in analytics.block_fingerprints(rows, "g", "i", F.col("t"), block=2).collect()}
    first = [sha([f"t{i}" for i in range(k, min(k + 2, 9))]) for k in range(0, 9, 2)]
    assert got == {"a": sha([sha(first[k : k + 2]) for k in range(0, 5, 2)]), "b": sha([sha([sha(["t0"])])])}


def test_rules_between_classes_stand_for_all_pairs(spark):
    rows = [(i % 2, i, "xyz"[i % 3], (i % 4) / 4) for i in range(20)] + [(0, 90, None, 0.5), (0, 91, "x", None), (7, 92, "x", 0.9)]
    rules = spark.createDataFrame([("x", "y", "leads", "FORWARD", 0.9)], "source_role string, target_role string, type string, direction string, weight double")
    anchors = spark.createDataFrame(rows, "g int, anchor_id int, role string, confidence double")
    got = relations.rule_relationships(anchors, rules, "g", ("near", "BIDIRECTIONAL", 0.3), 0.0).collect()
    want = Counter((a[0], a[2], a[3], b[2], b[3]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and None not in (a[2], a[3], b[2], b[3]))
    assert {(r.g, r.source_role, r.source_confidence, r.target_role, r.target_confidence): r.n_edges for r in got} == want
    assert {r.type for r in got if (r.source_role, r.target_role) == ("x", "y")} == {"leads"}


def test_equal_spans_are_met_once(spark):
    """40,000 points in 40,000 equal spans: 1.6 billion pairs, none of which is formed."""
    spans = spark.range(40_000).selectExpr("id as s", "10.0D as lo", "15.0D as hi").union(spark.createDataFrame([(90_000, 14.0, 21.0), (90_001, 3.0, None)], "s long, lo double, hi double"))
    points = spark.range(40_000).selectExpr("id as p", "12.0D as x").union(spark.createDataFrame([(50_000, 14.5), (50_001, 21.0), (50_002, 9.9), (50_003, None)], "p long, x double"))
    got = {r.p: (r.s, r.n_spans) for r in linking.range_tally(points, "p", "x", spans, "s", "lo", "hi", 5.0).collect()}
    assert got == {k: (39_999, 40_000) for k in range(40_000)} | {50_000: (90_000, 40_001), 50_001: (90_000, 1)}
