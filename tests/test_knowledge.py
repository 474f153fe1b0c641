"""Units, paths, links, indexes, graph checks and search through postings against plain loops, with nulls and empty tables."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import knowledge as K
from lodestone.operators import reach
from lodestone.operators import search as S

EDGES = "source string, target string, edge_type string, is_blocking boolean, edge_id int, confidence double"


def test_prerequisites_and_completeness(spark):
    edges = spark.createDataFrame(
        [("a", "c", "REQUIRES", True, 5, 0.1), ("a", "c", "REQUIRES", False, 2, 0.9), ("b", "c", "RECOMMENDED_BEFORE", None, 3, None), ("d", "c", "RELATED_TO", True, 1, 1.0), (None, "c", "REQUIRES", True, 9, 1.0), ("c", "z", "REQUIRES", True, 4, 2.0)], EDGES
    )
    refs = K.prerequisite_refs(edges, ["REQUIRES", "RECOMMENDED_BEFORE"])
    assert sorted(map(tuple, refs.collect()), key=str) == [("c", "a", False, 1), ("c", "b", None, 2), ("z", "c", True, 1)]
    units = spark.createDataFrame([("c", "text", 2), ("e", None, 0)], "concept_id string, text string, figures int")
    got = {r.concept_id: r for r in K.backfilled(units, refs, {"definition": F.col("text") != "", "figure": F.col("figures") > 0}).collect()}
    assert (got["c"].n_prerequisites, got["c"].n_blocking, got["c"].completeness) == (2, 1, round(6 / 18, 4))
    assert (got["e"].n_prerequisites, got["e"].n_blocking, got["e"].completeness) == (0, 0, 0.0)


def test_alternative_paths(spark):
    schema = "concept_id string, position int, is_optional boolean, has_examples boolean, minutes double"
    rows = [("a", 0, False, False, 1.0), ("b", 1, True, True, 2.0), ("c", 2, None, False, None), ("d", 3, False, True, 4.0)]
    paths = lambda x: {k: [(r.concept_id, r.minutes_so_far) for r in sorted(K.alternative_paths(spark.createDataFrame(x, schema)).where(F.col("path_type") == k).collect(), key=lambda r: r.position)] for k in ("minimal_prerequisites", "example_first")}
    assert paths(rows) == {"minimal_prerequisites": [("a", 1.0), ("c", 1.0), ("d", 5.0)], "example_first": [("b", 2.0), ("d", 6.0), ("a", 7.0), ("c", 7.0)]}
    assert paths([r for r in rows if not r[3]]) == {"minimal_prerequisites": [("a", 1.0), ("c", 1.0)], "example_first": []}
    assert paths(rows[:1]) == paths([]) == {"minimal_prerequisites": [], "example_first": []}


@pytest.mark.parametrize("parts", [1, 5])
def test_role_links_count_all_pairs(spark, parts):
    rng = random.Random(parts)
    names = ["defines_concept", "exemplifies_concept", "surfaces_misconception", "other", None]
    rows = [(k, rng.choice(names), rng.choice([0.1, 0.5, 0.9])) for k in range(150)]
    want = {}
    for i, (_, a, x) in enumerate(rows):
        for _, b, y in rows[i + 1 :]:
            for kind, pairs in (("reinforcing", K.REINFORCING), ("contrasting", K.CONTRASTING)):
                if (a, b) in pairs:
                    want[kind, a, x, b, y] = want.get((kind, a, x, b, y), 0) + 1
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "node long, role string, confidence double")
    got = K.role_links(df, {"reinforcing": K.REINFORCING, "contrasting": K.CONTRASTING}, parts=parts).collect()
    assert {(r.link_type, r.source_role, r.source_confidence, r.target_role, r.target_confidence): r.n_links for r in got} == want
    assert all(r.confidence == round((r.source_confidence + r.target_confidence) / 2, 4) for r in got)


def test_dependency_links(spark):
    edges = spark.createDataFrame([("a", "b", "", True, 2, 0.2), ("a", "b", "", True, 1, 1.7), ("b", "c", "", True, 3, None), (None, "c", "", True, 4, 0.5)], EDGES)
    related = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), ("c", "a")], "source string, target string")
    confidence = spark.createDataFrame([("a", 0.9), ("c", 0.2)], "node string, confidence double")
    got = sorted(tuple(r) for r in K.dependency_links(edges, related, confidence).collect())
    assert got == [("a", "b", "prerequisite", 1.0), ("a", "x", "related_concept", 0.7), ("b", "a", "successor", 1.0), ("b", "c", "prerequisite", 0.7), ("c", "a", "related_concept", 0.55), ("c", "b", "successor", 0.7)]


def test_graph_issues(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("alone",)], "node string")
    edges = spark.createDataFrame([(1, "a", "b", "R", 0.5), (2, "b", "a", "R", 1.5), (2, "b", "c", None, None), (3, "ghost", "c", "X", 0.0), (4, "c", "gone", "R", 1.0)], "edge_id int, source string, target string, type string, confidence double")
    got = sorted((r.rule, r.severity, r.object_id) for r in K.graph_issues(nodes, edges, ["R"]).collect())
    assert got == [("GIV001", "ERROR", "b"), ("GIV002", "WARNING", "2"), ("GIV003", "ERROR", "3"), ("GIV004", "ERROR", "4"), ("GIV005", "ERROR", "2"), ("GIV005", "ERROR", "3"), ("GIV006", "ERROR", "2"), ("GIV006", "ERROR", "2"), ("GIV007", "WARNING", "alone"), ("GIV008", "WARNING", "a")]
    lax = K.graph_issues(nodes, edges, ["R"], strict=False, cycles=False).collect()
    assert {r.severity for r in lax if r.rule in ("GIV003", "GIV004")} == {"WARNING"} and "GIV008" not in {r.rule for r in lax}
    assert K.graph_issues(nodes.limit(0), edges.limit(0), ["R"]).count() == 0


def test_indexes(spark):
    order = spark.createDataFrame([("a", 1, None, "text"), ("b", 0, "other", ""), ("c", 2, "core", None)], "concept_id string, position long, importance string, definition string")
    items = spark.createDataFrame([("a", "note", 2, 7), ("a", "note", 1, 9), ("b", "formula", 1, 3), ("x", "note", 1, 1), ("b", "figure", 1, 4)], "concept_id string, kind string, ord int, item_id int")
    got = sorted((r["index"], r.position, r.concept_id, r.nth, r.entry) for r in K.revision_index(order, items).collect())
    assert got == [("core", 1, "a", 1, "a"), ("core", 2, "c", 1, "c"), ("definition", 1, "a", 1, "text"), ("formula", 0, "b", 1, "3"), ("note", 1, "a", 1, "9"), ("note", 1, "a", 2, "7")]
    nodes = spark.createDataFrame([("n1", 1), ("n2", None)], "node string, concept_id int")
    edges = spark.createDataFrame([("n1", 10), ("n2", 11), ("n3", 12)], "source string, edge_id int")
    links = spark.createDataFrame([(5,), (None,)], "link_id int")
    assert sorted(map(tuple, K.traversal_index(nodes, edges, links).collect())) == [("by_concept", "1", "10"), ("cross_chapter", None, "5")]


def test_search_through_postings_equals_the_scan(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(30)] + ["the"]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 15)))) for k in range(80)] + [(90, None), (91, ""), (92, "the " * 50)]
    docs = spark.createDataFrame(rows, "id long, text string")
    S.write_index(docs, "id", "text", str(tmp_path / "index"), buckets=8)
    index = spark.read.parquet(str(tmp_path / "index"))
    queries = {1: ["w1", "w2", "the"], 2: ["w3", "w3"], 3: ["nothing"], 4: [], 5: ["the"]}
    asked = spark.createDataFrame(list(queries.items()), "q int, words array<string>")
    got = {}
    for r in S.search_index(index, asked, "q", "words", limit=7, buckets=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.key, r.score))
    for q, words in queries.items():
        scan = [(r.id, r.score) for r in S.search(docs, "id", "text", words, 7).collect()] if words else []
        assert sorted(got.get(q, [])) == [(i + 1, *x) for i, x in enumerate(scan)]
    plan = S.search_index(index, asked, "q", "words", buckets=8)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search("bucket", plan)


def test_goal_paths(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "c"), ("c", "d"), ("y", "y")]
    order = spark.createDataFrame([(c, i) for i, c in enumerate("xabcdyz")], "concept_id string, position int")
    labels = reach.reach_labels(spark.createDataFrame(edges, "source string, target string"))
    goals = spark.createDataFrame([("c",), ("c",), ("a",), ("z",), ("ghost",), (None,)], "goal string")
    got = {}
    for r in sorted(K.goal_paths(goals, labels, order).collect(), key=lambda r: (r.goal, r.nth)):
        got.setdefault(r.goal, []).append(r.concept_id)
    assert got == {"a": ["a"], "c": ["x", "a", "b", "c"], "z": ["z"]}


def test_long_rows_form_no_pairs(spark, tmp_path):
    """A word of all rows: queries that short rows answer are paired with no long row, and the best stay the same."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(["all", *rng.sample(words, rng.choice([0, 1, 2, 3, 5, 8, 20, 35]))]) for _ in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    S.write_index(docs, "id", "text", str(tmp_path / "i"), buckets=8)
    index = spark.read.parquet(str(tmp_path / "i"))
    queries = {"a": ["all"], "b": ["all", "w1", "w2"], "c": ["w3", "none"], "d": ["all", "none", "none"], "e": ["w5", "w6", "w7"], "f": ["none"]}
    asked = spark.createDataFrame(list(queries.items()), "q string, words array<string>")
    for limit in (1, 5, 50):
        got = {}
        for r in S.search_index(index, asked, "q", "words", limit=limit, buckets=8).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.key, r.score))
        for q, some in queries.items():
            scan = [(r.id, r.score) for r in S.search(docs, "id", "text", some, limit).collect()]
            assert sorted(got.get(q, [])) == [(i + 1, *x) for i, x in enumerate(scan)]
    plan = S.search_index(index, asked, "q", "words", buckets=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "token_most" in plan


@pytest.mark.parametrize("many, pairs", [(200_000, 4_000_000), (3, 50)])
def test_pairs_of_queries_and_rows_are_not_shuffled(spark, tmp_path, monkeypatch, many, pairs):
    """Every pair went through a shuffle by query and row; now postings are dealt by row, and a task's best of each query alone go on."""
    monkeypatch.setattr(S, "BROADCAST_TOKENS", many, raising=False)
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", pairs, raising=False)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(25)]
    docs = spark.createDataFrame([(k, " ".join(["all", *rng.sample(words, rng.choice([0, 1, 2, 5, 20]))])) for k in range(200)], "id long, text string")
    S.write_index(docs, "id", "text", str(tmp_path / "i"), buckets=4)
    queries = {k: rng.sample([*words, "all", "none"], rng.randrange(1, 4)) for k in range(12)}
    found = S.search_index(spark.read.parquet(str(tmp_path / "i")), spark.createDataFrame(list(queries.items()), "q int, words array<string>"), "q", "words", limit=6, buckets=4)
    got, plan = {}, found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.key, r.score))
    for q, some in queries.items():
        assert sorted(got.get(q, [])) == [(i + 1, r.id, r.score) for i, r in enumerate(S.search(docs, "id", "text", some, 6).collect())]
    assert not re.search(r"hashpartitioning\(query_id#\d+, key#", plan) and re.search(r"hashpartitioning\(key#", plan)
