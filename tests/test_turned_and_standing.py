"""Backward scans hold no task's rows in Python; boxes that stay are those of a plain loop, on small and large pages."""

import inspect
import random

from pyspark.sql import functions as F

from lodestone.operators import layout
from lodestone.operators import scan as S


def test_backward_scans_take_batches_as_they_come(spark):
    rows = spark.range(50_000).select(F.lit("g").alias("g"), F.col("id").alias("node"), (F.col("id") % 5).cast("int").alias("level"))
    dealt = S.in_ranges(rows, "g", "node", parts=3)
    turned = S._turned(dealt).withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.collect_list("node").alias("nodes")).collect()
    assert len(turned) == 3 and all(r.nodes == sorted(r.nodes, reverse=True) for r in turned)
    assert "list(batches)" not in inspect.getsource(S)
    closed = {r.node: r.closed_by for r in S.scan(dealt, S.Closing(), backward=True).collect()}
    last = {}
    for node in range(49_999, -1, -1):
        assert closed[node] == min((last[k] for k in range(node % 5 + 1) if k in last), default=None)
        last[node % 5] = node


def plain(rows):
    def iou(a, b):
        w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
        return w * h / union if union > 0 else 0.0

    taken = []
    for page, rank, box in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1]):
        if not any(p == page and (b == box or round(iou(b, box), 9) >= 0.5) for p, _, b in taken):
            taken.append((page, rank, box))
    return {r[1] for r in taken} | {r[1] for r in rows if r[0] is None}


def test_boxes_that_stay_on_small_and_large_pages(spark):
    r = random.Random(3)
    rows = []
    for rank in range(300):
        x, y = r.randrange(40), r.randrange(40)
        rows.append((r.choice([1, 1, 1, 2, 3, 4, None]), rank, (float(x), float(y), float(x + r.choice([0, 20, 25])), float(y + 20))))
    df = spark.createDataFrame(rows, "page int, rank long, box struct<x0: double, y0: double, x1: double, y1: double>")
    stay = lambda **kw: {x.rank for x in layout.standing(df, "page", "rank", "box", 0.5, 20.0, **kw).collect()}
    assert stay() == stay(most=10_000) == stay(most=1) == plain(rows)
    assert {x.rank for x in layout.standing(df, "page", "rank", "box", 0.5, 20.0, F.col("page") > 4).collect()} == {x[1] for x in rows}


def test_small_pages_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(layout, "dropped", lambda pairs: 1 / 0)
    df = spark.createDataFrame([(1, k, (0.0, 0.0, 1.0, 1.0)) for k in range(5)], "page int, rank long, box struct<x0: double, y0: double, x1: double, y1: double>")
    assert [x.rank for x in layout.standing(df, "page", "rank", "box", 0.5, 20.0).collect()] == [0]
