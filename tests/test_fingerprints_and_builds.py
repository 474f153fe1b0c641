"""Fingerprints of multisets, groupings in one scan, and builds that readers see whole or not at all."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.operators import fingerprint as I
from lodestone.operators import statistics as T
from lodestone.sources import builds as B

ROWS = "g string, a string, b int"


def rows_of(n=60, seed=0):
    rng = random.Random(seed)
    rows = [(rng.choice("xyz"), rng.choice(["p", "q", None, "", "␀", "␟", "p␟1"]), rng.choice([1, 2, None])) for _ in range(n)]
    return rows + rows[:5]  # repeated rows count


def prints(spark, rows):
    return {r.g: tuple(r) for r in I.fingerprint(spark.createDataFrame(rows, ROWS).repartition(3), ["g"], ["a", "b"]).collect()}


def test_order_does_not_matter_and_each_mutation_shows(spark):
    rows = rows_of()
    first = prints(spark, rows)
    assert prints(spark, random.Random(1).sample(rows, len(rows))) == first
    for k in range(0, len(rows), 9):
        g, a, b = rows[k]
        for other in [(g, a, 7), (g, "other", b), (g, None if a is not None else "", b)]:
            changed = prints(spark, rows[:k] + [other] + rows[k + 1 :])
            assert {x for x in first if changed.get(x) != first[x]} == {g}
        assert prints(spark, rows + [rows[k]])[g] != first[g]


def test_texts_of_rows_are_told_apart(spark):
    """Nulls, marks inside values and values that move over a border give different texts."""
    values = [None, "", "␀", "␟", "␀␀", "a", "a␟", "␟a"]
    rows = [(x, y) for x in values for y in values]
    df = spark.createDataFrame(rows, "a string, b string").select(I.row_text(["a", "b"]).alias("t"))
    assert df.distinct().count() == len(rows)


def test_fingerprints_add_and_subtract(spark):
    a, b = rows_of(40, 2), rows_of(25, 3) + [("new", "p", 1)]
    of = lambda rows: I.fingerprint(spark.createDataFrame(rows, ROWS), ["g"], ["a", "b"])
    assert {r.g: tuple(r) for r in I.plus(of(a), of(b), ["g"]).collect()} == prints(spark, a + b)
    assert {r.g: tuple(r) for r in I.plus(of(a + b), of(b), ["g"], -1).collect()} == prints(spark, a)
    same = {r.g: r.same for r in I.compared(of(a + b), of(a + b[:-1]), ["g"]).collect()}
    assert same == {"x": True, "y": True, "z": True, "new": False}
    assert of([]).count() == 0


def test_groupings_in_one_scan(spark):
    rows = [("x", 1), ("x", None), ("y", 1), (None, 2), (None, None)]
    df = spark.createDataFrame(rows, "g string, k int")
    sets = {"all": [], "g": ["g"], "k": ["k"], "both": ["g", "k"]}
    found = T.by_sets(df, sets, F.count("*").alias("n"), F.count_distinct("k").alias("kinds"))
    got = {(r.statistic, tuple(sorted(r["keys"].items()))): (r.n, r.kinds) for r in found.collect()}
    want = {}
    for name, cols in sets.items():
        groups = {}
        for g, k in rows:
            groups.setdefault(tuple(sorted((c, None if v is None else str(v)) for c, v in (("g", g), ("k", k)) if c in cols)), []).append(k)
        want |= {(name, key): (len(v), len({x for x in v if x is not None})) for key, v in groups.items()}
    assert got == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("LogicalRDD") == 1
    with pytest.raises(ValueError):
        T.by_sets(df, {"a": ["g"], "b": ["g"]}, F.count("*"))


def test_distinct_values_are_counted_without_repeating_rows(spark):
    r = random.Random(5)
    rows = [(r.choice(["x", "y", None]), r.choice([1, 2, None]), r.choice([None, *range(9)]), r.choice("abc")) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, h int, k int, s string")
    sets = {"all": [], "g": ["g"], "h": ["h"], "both": ["g", "h"]}
    found = T.by_sets(df, sets, F.count("*").alias("n"), distinct={"kinds": "k", "signs": "s", "hs": "h"})
    plain = T.by_sets(df, sets, F.count("*").alias("n"), F.count_distinct("k").alias("kinds"), F.count_distinct("s").alias("signs"), F.count_distinct("h").alias("hs"))
    assert found.columns == plain.columns
    of = lambda t: {(x.statistic, tuple(sorted(x["keys"].items()))): (x.n, x.kinds, x.signs, x.hs) for x in t.collect()}
    assert of(found) == of(plain) and len(of(found)) == 1 + 3 + 3 + 9


def test_graph_statistics_repeat_distinct_values_and_not_edges(spark, data):
    plan = catalog.QUERIES["knowledge_graph_statistics"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 2 and "gid#" not in plan  # gid: Spark's own repetition of all rows for each count of distinct values


def test_a_build_is_seen_whole_or_not_at_all(spark, tmp_path):
    root, df = str(tmp_path), spark.range(20)
    assert B.committed(spark, root).count() == 0
    B.commit_build(root, "b1", {"nodes": df, "edges": df.selectExpr("id as source", "id + 1 as target")})
    broken = spark.range(5).select(F.raise_error(F.lit("the writer fails")).cast("long").alias("id"))
    with pytest.raises(Exception, match="the writer fails"):
        B.commit_build(root, "b2", {"nodes": df, "edges": broken})
    assert {(r.build_id, r.table_name, r.n) for r in B.committed(spark, root).collect()} == {("b1", "nodes", 20), ("b1", "edges", 20)}
    assert B.load_build(spark, root, "nodes").count() == 20
    B.commit_build(root, "b2", {"nodes": df.limit(3)})
    B.commit_build(root, "b1", {"nodes": df.limit(7)})  # again: the whole build is replaced
    assert {(r.build_id, r.table_name, r.n) for r in B.committed(spark, root).collect()} == {("b1", "nodes", 7), ("b2", "nodes", 3)}
    assert B.load_build(spark, root, "nodes").count() == 3 and B.load_build(spark, root, "nodes", "b1").count() == 7
    with pytest.raises(LookupError):
        B.load_build(spark, root, "edges")
    assert len(list((tmp_path / "data").iterdir())) == 4  # two of them are seen by nobody
    B.remove_builds(spark, root, keep=1)
    assert {r.build_id for r in B.committed(spark, root).collect()} == {"b2"} and len(list((tmp_path / "data").iterdir())) == 1
    assert B.damaged(spark, root).count() == 0
    path = B.committed(spark, root).first()["path"]
    spark.range(1).write.mode("append").parquet(path)
    assert [tuple(r) for r in B.damaged(spark, root).collect()] == [("b2", "nodes")]
