"""Distinct words of lines: a text's own words are not shuffled."""

from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.plans import text_plans


def test_words_are_those_of_all_lines_with_a_key_once(spark):
    docs = [(1, "a b\nb  c\n"), (1, "c d"), (2, ""), (3, None), (None, "x y"), (None, "y z"), (4, " a\n\nA a")]
    turns = [(1, 0, "p q\nq"), (1, 0, "q r"), (1, 1, "p")]
    tables = {"documents": spark.createDataFrame(docs, "doc_id long, text string"), "conversations": spark.createDataFrame(turns, "conv_id long, turn long, text string")}
    got = sorted((str(r.line_id), r.s) for r in text_plans.line_words(tables.get).collect())
    keyed = [(f"d{k}" if k is not None else None, t) for k, t in docs] + [(f"c{c}-{n}", t) for c, n, t in turns]
    want = {(k, w) for k, t in keyed if t is not None for line in t.split("\n") for w in line.split(" ")}
    assert got == sorted((f"{k}:{w}" if k is not None else "None", w) for k, w in want)


def test_words_of_single_texts_are_not_shuffled(spark, data):
    found = catalog.QUERIES["roman_numerals"](spark, data)
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "LeftAnti" in plan
    words = found.where(F.col("line_id").startswith("d"))
    assert words.count() == words.distinct().count()
