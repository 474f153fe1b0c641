"""Text and numeral functions on cases worked out by hand, with nulls and empty texts."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X

CASES = [
    (lambda c: X.slug(c), "  Newton's 2nd Law! ", "newton-s-2nd-law"),
    (lambda c: X.slug(c), "", "item"),
    (lambda c: X.tokens(c), "Force = m*a, 2nd", ["force", "m", "a", "2nd"]),
    (lambda c: X.keywords(c), "The law of motion", ["law", "motion"]),
    (lambda c: X.roman(c), "XIV", 14),
    (lambda c: X.roman(c), "IIX", None),
    (lambda c: X.roman(c), None, None),
    (lambda c: X.devanagari(c), "१२", 12),
    (lambda c: X.devanagari(c), "1x", None),
    (lambda c: X.number_depth(c), "1.2.3", 3),
    (lambda c: X.number_depth(c), "7", None),
    (lambda c: X.fix_punctuation(c), "a ,b", "a, b"),
    (lambda c: X.split_case(c), "helloWorld", "hello World"),
    (lambda c: X.defined_term(c), "Inertia is defined as rest", "Inertia"),
    (lambda c: X.lookup_key(c), " (A  Name). ", "a name"),
    (lambda c: X.lookup_key(c), " .. ", None),
    (lambda c: X.expand_ligatures(c), "eﬃcient", "efficient"),
    (lambda c: X.cap_words(c, 2), "a b c", "a b..."),
    (lambda c: X.cross_references(c), "see Figure 2.1 and Table 3, as shown in table 4", ["figure: see Figure 2.1", "table: as shown in table 4"]),
    (lambda c: X.is_step(c), "Step 3: find it", True),
    (lambda c: X.is_step(c), None, False),
    (lambda c: X.devanagari(c), " १२ ", 12),
    (lambda c: X.to_roman(c.cast("int")), "1994", "MCMXCIV"),
    (lambda c: X.compare_numbers(c, F.lit("1.2.10")), "1.2.9", -1),
    (lambda c: X.compare_numbers(c, F.lit("1.2.10")), "1.2", -1),
    (lambda c: X.compare_numbers(c, F.lit("1.2.10")), "12", None),
    (lambda c: X.marker_index(c), "(b)", 2),
    (lambda c: X.defined_term(c), "It is called this.", None),
    (lambda c: X.detect_script(c), "अब यह", "devanagari"),
    (lambda c: X.detect_script(c), "123", None),
    (lambda c: X.confidence_band(c.cast("double")), "0.4", "medium"),
]


@pytest.mark.parametrize(("expression", "given", "want"), CASES)
def test_function(spark, expression, given, want):
    assert spark.createDataFrame([(given,)], "s string").select(expression(F.col("s")).alias("x")).first()[0] == want


def test_uuid5_is_that_of_python(spark):
    names = ["", "a", "Größe", "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(X.uuid5(str(uuid.NAMESPACE_URL), F.col("s"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_iou(spark):
    row = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0)], "a_x0 double, a_y0 double, a_x1 double, a_y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    assert abs(row.select(X.iou("a", "b")).first()[0] - 1 / 3) < 1e-12
