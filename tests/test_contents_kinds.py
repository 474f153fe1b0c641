"""Shapes of lines of contents are asked once; small groups of lines are not dealt by ranges."""

from pyspark.sql import functions as F

from lodestone.functions import contents as C
from lodestone.operators import layout
from lodestone.operators import scan as S


def test_contents_of_small_groups_are_not_dealt_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "in_ranges", lambda *a, **k: 1 / 0)
    lines = spark.createDataFrame([("g", k, f"{k}. Name {k}", 1.0) for k in range(1, 5)], "g string, i long, t string, r double")
    assert layout.contents_blocks(lines, "g", "i", "t", "r").count() == 4


def test_a_line_is_asked_once_whether_it_is_an_entry(spark):
    kind = C.row_kind(F.col("s")).alias("k")
    df = spark.createDataFrame([(x,) for x in ["1. Name 7", "Contents", "Name", "12", "xiv", "", "  ", "A line.", "Name . . . 9", "  1. Name 7  ", "x" * 61, "xivxlcd", None]], "s string")
    plan = df.select(kind)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(C.DOTTED_LEADER) == 1
    assert [r[0] for r in df.select(kind).collect()] == ["entry", "other", "filler", "filler", "filler", "filler", "filler", "other", "entry", "entry", "other", "filler", "other"]
    assert all(r.a == r.b for r in df.select(kind.alias("a"), C.kind_of_stripped(C.stripped(F.col("s"))).alias("b")).collect())


def test_numbers_of_entries_are_those_below_200(spark):
    heads = ["", "Unit ", "a1 ", "Unit"]
    df = spark.createDataFrame([(f"{h}{z}{n}{e}",) for h in heads for z in ("", "0", "000") for n in (0, 7, 19, 99, 100, 199, 200, 250, 1999) for e in (". Name", ") N", ".3.400 N", " N", "N", ".", "-1 N", "")], "s string")
    number = F.regexp_extract("s", C.LEADING_NUMBER, 1)
    plain = F.coalesce((number != "") & (number.try_cast("int") < 200), F.lit(False))
    assert df.where(plain != F.col("s").rlike(C.ENTRY_NUMBER)).count() == 0 and df.where(plain).count() > 100
