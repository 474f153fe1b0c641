"""Rounds of a closure go over edges between nodes that have edges of their own."""

import random

from lodestone.operators import graph


def plain(edges):
    found = set(edges)
    while more := {(a, t) for a, b in found for s, t in edges if b == s} - found:
        found |= more
    return found


def test_closure_is_that_of_a_plain_loop_with_cycles_and_leaves(spark):
    r = random.Random(7)
    for n in (1, 12, 30):
        edges = [(f"n{r.randrange(12)}", f"n{r.randrange(24)}") for _ in range(n)] + [("a", "b"), ("a", "b"), ("z", "z")]
        got = [tuple(x) for x in graph.closure(spark.createDataFrame(edges, "source string, target string")).select("ancestor", "node").collect()]
        assert len(got) == len(set(got)) and set(got) == plain(set(edges))


def test_edges_to_leaves_are_written_once(spark, monkeypatch):
    written, kept = [], graph.kept

    def counted(df):
        found = kept(df)
        written.append(found.count())
        return found

    monkeypatch.setattr(graph, "kept", counted)
    edges = [("r", "n1"), ("r", "n2")] + [(f"n{1 + k % 2}", f"leaf{k}") for k in range(200)]
    assert graph.closure(spark.createDataFrame(edges, "source string, target string")).count() == 402
    assert sum(written) < 220  # 202 edges and what lies between nodes; 604 with pairs that end at leaves
