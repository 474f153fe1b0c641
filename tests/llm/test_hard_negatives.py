"""Hard negatives against brute force in whole numbers."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives
from lodestone.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, rank string"


def brute(rows, every=10, positives=5, negatives=3):
    good = [(i, [int(np.floor(256 * np.float64(np.float32(c)))) for c in v], l) for i, v, l, *_ in rows]
    out, seen = [], set()
    for a, x, label in good:
        if a % every or (a, tuple(x), label) in seen:
            continue
        seen.add((a, tuple(x), label))
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, l) for i, y, l in good if i != a)
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            hard = [(ns, i) for ns, i, l in scored if l != label and 50 * -ps <= 100 * -ns <= 95 * -ps]
            out += [(a, p, r, i, -ps, -ns) for r, (ns, i) in enumerate(hard[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every=10, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(tuple(r)[:6] for r in hard_negatives.hard_negatives(df, F.col("vec_id") % every == 0, **more).collect())


def rows_of(n, dim, scale=1.0, seed=0, labels=4):
    rng = np.random.default_rng(seed)
    x = (scale * rng.normal(size=(n, dim))).astype("f4")
    x[50:80] = x[50]  # copies: ties
    x[80:100] = x[50] * 0.8
    x[100:120] = 0
    return [(i, v.tolist(), 0 if i % 3 == 0 else int(rng.integers(labels)), "clash", "clash") for i, v in enumerate(x)]


BAD = [(None, [1.0] * 9, 0, "", ""), (1000, None, 0, "", ""), (1010, [None] + [1.0] * 8, 0, "", ""), (1020, [float("nan")] * 9, 0, "", ""), (1030, [float("inf")] * 9, 0, "", ""), (1040, [1.0], 0, "", ""), (1050, [], 0, "", ""), (1060, [1.0] * 9, None, "", "")]


@pytest.mark.parametrize("pack, width", [(4096, 2), (32, 4)])
def test_rows_with_all_edges(spark, monkeypatch, pack, width):
    monkeypatch.setattr(hard_negatives, "PACK_ROWS", pack)
    monkeypatch.setattr(hard_negatives, "PACK_ANCHORS", max(5, pack // 4))
    rows = rows_of(400, 9)
    rows += [rows[3], rows[10], rows[55], (20, rows[70][1], 1, "", "")]  # repeated rows, an anchor's id with another vector
    got = mined(spark, rows + BAD, width=width)
    assert got == brute(rows) and len(got) > 300
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame(BAD, SCHEMA), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.lit(False)).count() == 0


def test_scores_beyond_doubles(spark):
    """Integer products over 2^53 stay exact."""
    rows = rows_of(150, 9, scale=3e4)
    assert mined(spark, rows) == brute(rows)


def test_few_rows_and_one_label(spark):
    rows = rows_of(150, 9)[:8]
    assert mined(spark, rows, every=1) == brute(rows, every=1)
    assert mined(spark, [(i, v, 1, a, r) for i, v, _, a, r in rows], every=1) == []


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(2)
    x = (32 * rng.normal(size=(3000, 64))).astype("i4")
    book = hard_negatives.Codebook(x[:1000], 2)
    codes, norms = book.encode(x)
    step = norms.max() / 254
    rows = {"x": x, "codes": codes, "steps": np.ceil(norms / step * (1 + 1e-9)).astype("u1"), "step": np.full(len(x), step)}
    tile = hard_negatives.Tile(book, {"x": x[:60]}, rows)
    low, high = tile.bounds(np.arange(60), slice(None))
    exact = x.astype("i8") @ x[:60].astype("i8").T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 1.5 * exact.std()
    left = high >= hard_negatives.kth_largest(low, 5)
    assert left.mean() < 0.15


def test_query_over_the_whole_table_and_its_sql(spark, duck, data):
    got = sorted(tuple(r) for r in op13_hard_negatives(spark, data).collect())
    assert got == sorted(duck.execute(hard_negatives.MINED_SQL).fetchall()) and got


def test_tiles_repeat_and_broadcast_no_packs(spark, monkeypatch):
    """Packs of anchors, which Spark takes for small, were repeated for each pack of rows and broadcast: a table that grew with the square of the rows."""
    plans, tiles = [], hard_negatives.over_tiles

    def seen(*given):
        plans.append(tiles(*given))
        return plans[-1]

    for name, value in (("over_tiles", seen), ("PACK_ROWS", 32), ("PACK_ANCHORS", 8)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = rows_of(400, 9)
    assert mined(spark, rows) == brute(rows)
    first, second = (p._jdf.queryExecution().executedPlan().toString() for p in plans)
    assert "CartesianProduct" in first and "Generate" not in first and "Broadcast" not in first
    assert "CartesianProduct" in second and "Generate" not in second


def test_the_sample_is_picked_before_it_is_ordered(spark):
    """Each task sent its first 4,096 rows to the driver."""
    rows = spark.range(20_000).selectExpr("id as vec_id", "array(cast(id as int)) as embedding")
    want = [r.vec_id for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(100).collect()]
    assert hard_negatives.first_by_hash(rows, 20_000, 100)[:, 0].tolist() == want
    same = spark.range(500).selectExpr("7L as vec_id", "array(cast(id as int)) as embedding")
    assert len(hard_negatives.first_by_hash(same, 500, 100)) == 100 and len(hard_negatives.first_by_hash(same, 500, 1000)) == 500
