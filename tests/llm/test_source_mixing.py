"""Rows with equal or null ids: as many are taken as the target needs, and the SQL says the same."""

from __future__ import annotations

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import source_mixing

ROWS = "doc_id long, text string, source string, nth int"


@pytest.mark.parametrize("doc_id", [None, 7])
@pytest.mark.parametrize("same_text", [True, False])
def test_repeated_ids_come_near_the_target(spark, tmp_path, doc_id, same_text):
    text = lambda i: " ".join(["word"] * 99 + ["same" if same_text else f"w{i}"])
    rows = [(doc_id, text(i), "a", i) for i in range(700)] + [(1000 + i, " ".join(["x"] * (50 + i % 7)), "b", i) for i in range(300)] + [(doc_id, "few words", "c", 0), (doc_id, None, None, 0)]
    docs = spark.createDataFrame(rows, ROWS).repartition(6)
    got = source_mixing.mix_table(docs, weights=(1, 3, 1), budget=0.7).withColumn("s", F.col("source_size")).collect()
    size = collections.Counter()
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert r.taken <= 2 * r.size
    for s in ("a", "b"):
        assert abs(taken[size[s]] - target[size[s]]) <= 100
    assert sum(r.taken for r in source_mixing.mix_sources(docs, weights=(1, 3, 1), budget=0.7).selectExpr("mix_size * copies as taken").collect()) == sum(taken.values())
    path = str(tmp_path / "documents.parquet")
    docs.toPandas().to_parquet(path)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}'")
    want = c.execute(source_mixing.MIX_SQL).fetchall()
    have = [tuple(r) for r in source_mixing.mix_table(spark.read.parquet(path)).collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_many_sources_are_ranked_and_filled_in_ranges(spark):
    rows = [(i, "one two three"[: 3 + 10 * (i % 2)], f"s{i % 997:04d}", i) for i in range(4000)]
    got = {r.source_size: r for r in source_mixing.mix_table(spark.createDataFrame(rows, ROWS)).collect()}
    assert got
    sizes = spark.createDataFrame([(f"s{i:04d}", 10 + i) for i in range(500)] + [(None, 5)], "source string, source_size long")
    held = source_mixing.source_targets(sizes, (5, 2, 1), 1.5, 2.0).collect()
    assert abs(sum(r.target for r in held) - 1.5 * sum(r.source_size for r in held)) < 1e-6 and all(r.target <= 2 * r.source_size for r in held)
