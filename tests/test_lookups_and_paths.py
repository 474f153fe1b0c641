"""Lookups, orders, cycles, chains, merged lines and recognisers on small cases worked out by hand, with nulls and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import recognise as R
from lodestone.operators import graph as G
from lodestone.operators import lookup as L
from lodestone.operators import ordered as O
from lodestone.operators import reach

EDGES = "source string, target string"


def test_cycles_and_chains(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "x"), ("e", "f"), ("f", "e")], EDGES)
    assert {r.node for r in reach.strong_components(e).collect()} == {"a", "b", "c", "x", "e", "f"}
    assert reach.strong_components(spark.createDataFrame([], EDGES)).count() == 0
    e = spark.createDataFrame([("r", "b"), ("r", "a"), ("a", "z"), ("b", "z"), ("z", "y"), ("r", "y"), ("q", "p")], EDGES)
    got = {r.node: "".join(r.path) for r in G.shortest_paths(e, spark.createDataFrame([("r",)], "node string")).collect()}
    assert got == {"r": "r", "a": "ra", "b": "rb", "z": "raz", "y": "ry"}


def test_lookups_and_orders(spark):
    rows = spark.createDataFrame([(1, "a", 2, 10), (1, "b", 1, 11), (1, "a", 1, 12), (2, "a", 1, 13), (None, "a", 1, 14), (1, "c", 0, 15)], "concept_id long, kind string, ord int, item_id long")
    ids = spark.createDataFrame([(1,), (1,), (9,), (None,)], "concept_id long")
    assert [(r.item_id, r.nth) for r in L.items(rows, ids, ["b", "a"]).orderBy("nth").collect()] == [(11, 1), (12, 2), (10, 3)]
    assert L.items(rows, ids.limit(0), ["a"]).count() == 0
    some = spark.createDataFrame([(i * 37 % 100, i) for i in range(100)], "k int, v int")
    assert [(r.k, r.position) for r in L.in_order(some, ["k"]).orderBy("k").collect()] == [(k, k) for k in range(100)]
    best = L.best_by(spark.createDataFrame([("g", 2, 1), ("g", 1, 9), ("g", 1, 3)], "g string, a int, b int"), "g", ["a", "b"]).collect()
    assert [tuple(r) for r in best] == [("g", 1, 3)]


def test_merged_runs(spark):
    rows = spark.createDataFrame([(1, 0, "It goes"), (1, 1, "on here."), (1, 2, "New one"), (1, 3, "Other"), (2, 0, "small"), (2, 5, "too")], "d long, i int, t string")
    got = O.merged_runs(rows, "d", "i", "t", F.col("t").rlike("^[a-z]")).orderBy("d", "block").collect()
    assert [(r.d, r.first_line, r.n_lines, r.text) for r in got] == [(1, 0, 2, "It goes on here."), (1, 2, 1, "New one"), (1, 3, 1, "Other"), (2, 0, 2, "small too")]


@pytest.mark.parametrize(("lines", "want"), [(["v = u + a t"], ("formula", 0.85)), (["v = u + a t", "= 3"], ("generic_visual", 0.5)), (["Solution", "Given a b", "c"], ("worked_example", 0.8)), (["debit the receiver"], ("accounting_rule", 0.85)), ([" ", None], None), (None, None), (["plain words"], ("generic_visual", 0.5))])
def test_best_recogniser(spark, lines, want):
    df = spark.createDataFrame([(lines,)], "lines array<string>").select(R.stripped(F.col("lines")).alias("b"))
    got = df.select(R.best_match(R.matched(R.block_recognisers(F.col("b")))).alias("m")).first()["m"]
    assert (got and (got.recognizer, got.confidence)) == want


@pytest.mark.parametrize(("text", "want"), [("1.", "numbered"), ("1.2.3", "hierarchical"), ("IV", "roman"), ("(b)", "alphabetic"), ("Chapter IV", "chapter_number"), ("The Living World", "chapter_title"), ("a plain line.", None), ("", None), (None, None)])
def test_first_heading_recogniser(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string").select(R.clean_heading(F.col("s")).alias("s"))
    got = df.select(R.heading_matches(F.col("s")).alias("m")).first()["m"]
    assert (got[0].recognizer if got else None) == want
