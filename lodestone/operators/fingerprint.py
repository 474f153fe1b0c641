"""Fingerprints of tables as multisets of rows: the order of rows does not matter, and a diff's rows are added and taken away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL, BETWEEN = "␀", "␟"
PARTS = ("n", "low", "high")


def row_text(columns: list[str]) -> Column:
    """A row's values as one text; null is told from any text, and a value's end from the next one's begin."""
    mark = lambda c: F.replace(F.replace(c, F.lit(NULL), F.lit(NULL + NULL)), F.lit(BETWEEN), F.lit(NULL + BETWEEN))
    return F.concat_ws(BETWEEN, *(F.coalesce(mark(F.col(c).cast("string")), F.lit(NULL)) for c in columns))


def fingerprint(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, n, low, high): the number of rows and the sums of two 60-bit halves of their MD5; one aggregate with partial sums.

    Two multisets of rows with equal fingerprints are the same but for a chance of about 2^-120.
    """
    part = lambda at: F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(38,0)")
    hashed = rows.select(*by, F.md5(row_text(columns)).alias("_h")).select(*by, part(1).alias("low"), part(16).alias("high"))
    return hashed.groupBy(*by).agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"))


def plus(a: DataFrame, b: DataFrame, by: list[str], sign: int = 1) -> DataFrame:
    """The fingerprint of the rows of both tables, or, with ``sign`` -1, of the first without those of the second."""
    signed = b.select(*by, *((F.col(c) * sign).cast(a.schema[c].dataType).alias(c) for c in PARTS))
    total = a.unionByName(signed).groupBy(*by).agg(*(F.sum(c).alias(c) for c in PARTS))
    return total.select(*by, *(F.col(c).cast(a.schema[c].dataType).alias(c) for c in PARTS)).where("n <> 0 or low <> 0 or high <> 0")


def compared(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, same): whether each group's fingerprints agree; a group of one side alone does not."""
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    off = [F.sum(F.col(c) * F.col("_side")) == 0 for c in PARTS]
    return both.groupBy(*by).agg((off[0] & off[1] & off[2] & (F.count("*") == 2)).alias("same"))
