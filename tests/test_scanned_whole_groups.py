"""Groups that are small are scanned whole, in one pass; large ones by ranges, with the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import layout
from lodestone.operators import scan as S


def pieces(n=900):
    r = random.Random(11)
    return [(r.choice(["a", "a", "b", "c", None]), r.choice([None, *range(40)]), r.choice([0.0, 1.0, None]), k, r.choice([True, True, False, None])) for k in range(n)]


def plain(rows):
    first = lambda x: (x is not None, x or 0)
    found, state = {}, {}
    for g, page, _, node, on in sorted(rows, key=lambda x: (str(x[0]), first(x[1]), first(x[2]), x[3])):
        at, head = state.get(g, (None, None))
        found[node] = head if on and page is not None and at is not None and at == page - 1 else node
        state[g] = page, found[node]
    return found


@pytest.mark.parametrize("how", [{}, {"most": 100}, {"most": 0}, {"parts": 7}])
def test_pieces_over_pages_with_whole_and_cut_groups(spark, how):
    df = spark.createDataFrame(pieces(), "g string, page long, top double, node long, more boolean")
    keyed = df.withColumn("_page", F.col("page")).withColumn("_node", F.col("node")).withColumn("_on", F.col("more"))
    got = S.scanned(keyed, S.Pages(), "g", "page", "top", "node", **how)
    assert {x.node: x["head"] for x in got.collect()} == plain(pieces())


def test_pages_summaries_are_those_of_a_plain_scan():
    rows, r, rule = [x[1:] for x in sorted(pieces(60), key=lambda x: (x[1] or 0))], random.Random(2), S.Pages()
    of = lambda part: {"_n": len(part), "_page": [x[0] for x in part], "_node": [x[2] for x in part], "_on": [x[3] for x in part]}
    for _ in range(50):
        a, b = sorted(r.sample(range(1, 60), 2))
        state = rule.step(rule.start(), of(rows[:a]))[0]
        want = rule.step(rule.step(rule.start(), of(rows[:a]))[0], of(rows[a:b]))[0]
        assert rule.after(state, rule.extend(rule.empty(), of(rows[a:b]))) == want


def test_small_groups_are_neither_dealt_by_ranges_nor_joined(spark, monkeypatch):
    monkeypatch.setattr(S, "in_ranges", lambda *a, **k: 1 / 0)
    df = spark.createDataFrame(pieces(), "g string, page long, top double, node long, more boolean")
    found = layout.over_pages(df, "g", "page", "top", "node", F.col("more"))
    assert found.columns == [*df.columns, "head"] and {x.node: x["head"] for x in found.collect()} == plain(pieces())
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
