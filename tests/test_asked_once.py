"""Costly expressions are asked once a row, and patterns only where their words stand."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions import fixed as V
from lodestone.functions import recognise as R
from lodestone.functions import text as X
from lodestone.sources import lines as S

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_objects_ask_each_recogniser_once(spark):
    plan = plan_of(catalog.QUERIES["recognised_objects"](spark, SF))
    of_one = plan_of(catalog.QUERIES["recognised_blocks"](spark, SF))
    assert plan.count("longitudinal section") == of_one.count("longitudinal section")


@pytest.mark.parametrize(
    "text",
    ["Dr. x", "ABC CR", "the dr", "hundred across", "INPUT x", "if a\nthen b", "if a then b", "x\n  GIVEN y", "xGIVEN", "x;\ny", "x; y", "for i in x", "forin", "return\n", "prints (", "classes", "L F and Date", "l.f. lf", "a\x85given b", "a = b", "= 1\nx", "a ... b", "x &= 1", "VS. y\nz", "İDebit what goes", "credit WHAT goes out", "2 -> H2O C", "Kround"],
)
def test_patterns_behind_words_find_what_they_find_alone(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(R.stripped(F.split("t", "\n")).alias("b"))
    b, code = F.col("b"), F.array_join("b", "\n")
    plain = {
        "algorithm": R.some(b, V.ALGORITHM) & R.worded(b), "journal_procedure": R.some(b, V.JOURNAL, "[a-zA-Z]"), "worked_example": (R.some(b, V.SOLUTION) | R.some(b, V.GIVEN_FIND)) & R.worded(b),
        "programming_syntax": code.rlike(V.CODE_HINT), "pseudocode": code.rlike(V.PSEUDOCODE), "accounting_rule": R.some(b, V.GOLDEN_RULE), "ledger": F.array_join("b", " ").rlike(V.LEDGER_HEADER),
    }
    found = R.block_recognisers(b)
    row = df.select(*[found[n].isNotNull().alias(n) for n in plain], *[c.alias("plain_" + n) for n, c in plain.items()]).first()
    assert {n: row[n] for n in plain} == {n: row["plain_" + n] for n in plain}


def test_code_hints_are_the_alternatives_of_the_pattern():
    parts = [p or re.escape(word) for word, p in V.CODE_HINTS]
    assert sorted(x.replace("\\#", "#") for x in parts) == sorted(V.CODE_HINT[3:-1].split("|"))


def test_headings_ask_each_recogniser_once(spark):
    once = plan_of(catalog.QUERIES["heading_matches"](spark, SF)).count("chapter|unit|lesson")
    assert plan_of(catalog.QUERIES["heading_resolved"](spark, SF)).count("chapter|unit|lesson") == once


def test_long_lines_are_no_headings(spark):
    df = spark.createDataFrame([("Unit " + "1" * 200,), ("Unit 1",), ("",)], "s string")
    assert [x.n for x in df.select(F.size(R.heading_matches(F.col("s"))).alias("n")).collect()] == [0, 1, 0]


def test_code_patterns_are_found_only_with_their_words(spark):
    texts = ["x:\ny", "a;\n", "System.out.print", "Elif", "DO it", "a == b", "a = b", " # x", "int x; // y", "include", "FROM x", "VOID f (", "Throw", "plain", "K:", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    kinds = (*V.CODE_LANGUAGES, *V.CODE_CONSTRUCTS)
    for name, p in kinds:
        both = df.select(F.coalesce(F.col("s").rlike(p), F.lit(False)).alias("a"), F.coalesce(X.holds(F.lower("s"), *V.CODE_WORDS[name]) & F.col("s").rlike(p), F.lit(False)).alias("b")).collect()
        assert all(x.a == x.b for x in both), name


def test_characters_are_counted_as_the_patterns_find_them(spark):
    df = spark.createDataFrame([("aÀß Ωx",), ("ж 𐐷 क़ क\u093c 12",), ("",), (None,), ("\U0001d49c_x\n",)], "s string")
    for signs in (r"[\p{L}]", *V.SCRIPTS.values()):
        assert all(x.a == x.b for x in df.select(X.count_in(F.col("s"), signs).alias("a"), F.regexp_count("s", F.lit(signs)).alias("b")).collect())


def test_repeated_lines_do_not_deal_all_lines_by_group(spark):
    df = spark.createDataFrame([("en", k, line) for k in range(4) for line in ("again", f"only {k}")], "lang string, doc long, line string")
    found = S.repeated_lines(df, "lang", "doc", "line")
    assert [(x.lang, x.line, x.n) for x in found.collect()] == [("en", "again", 4)]
    assert "broadcast" in plan_of(found)
