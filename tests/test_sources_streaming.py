"""Sources, sinks and streams on small files."""

from __future__ import annotations

import json

from pyspark.sql import types as T

from lodestone.sources import builds, lines
from lodestone.streaming import events


def test_listing_and_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.json").write_text(json.dumps({"id": 1}))
    (tmp_path / "a/y.json").write_text("{broken")
    assert {(r.folder, r.name) for r in builds.listing(spark, str(tmp_path), "*.json").collect()} == {("a", "x.json"), ("a", "y.json")}
    got = builds.read_documents(spark, str(tmp_path / "a"), T.StructType([T.StructField("id", T.LongType())]))
    assert [tuple(r) for r in got.collect()] == [(1,)]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    for b in ("b1", "b2"):
        builds.persist_snapshot(spark.createDataFrame([(b, "a", b)], "build_id string, artifact string, fingerprint string"), path)
    assert builds.load_snapshot(spark, path, "b2").select("fingerprint").first()[0] == "b2"
    all_builds = spark.createDataFrame([("b1", True), ("b2", False), ("b3", True)], "build_id string, valid boolean")
    assert builds.previous_build(all_builds, "b3").first()[0] == "b1"


def test_copies(spark):
    a = spark.createDataFrame([(1, b"x"), (2, b"y"), (3, b"z")], "id int, c binary")
    b = spark.createDataFrame([(1, b"x"), (2, b"!")], "id int, c binary")
    assert {r.id: r.status for r in builds.copied_right(a, b, "id", "c").collect()} == {1: "verified", 2: "differs", 3: "missing"}
    assert [r.id for r in builds.still_to_do(a, b, "id").collect()] == [3]


def test_lines(spark):
    docs = spark.createDataFrame([(1, "a\n\nb", "<h1>T x</h1><p class='q'>one<b>two</b></p>"), (2, None, None)], "doc_id int, text string, html string")
    assert [tuple(r) for r in lines.text_lines(docs, "doc_id", "text").collect()] == [(1, 0, "a"), (1, 2, "b")]
    assert [(r.tag, r.line) for r in lines.html_blocks(docs, "doc_id").collect()] == [("h1", "T x"), ("p", "one two")]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "view", 1.0, 1), ("2024-01-01 00:20:00", "view", 2.0, 1), ("2024-01-01 05:00:00", "buy", 5.0, 2)], "ts string, kind string, value double, user int").selectExpr("cast(ts as timestamp) ts", "kind", "value", "user")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, made, want in (("counts", events.windowed_counts(stream, "ts", "kind", "value"), 1), ("firsts", events.first_of_key(stream, "user", "ts"), 2)):
        q = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == want  # the last window is still open
