"""Statistics by several groupings in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_sets(rows: DataFrame, sets: dict[str, list[str]], *measures: Column, distinct: dict[str, str] | None = None) -> DataFrame:
    """(measures, ``distinct``, statistic, keys): a row for each group of each named grouping; ``keys`` maps a grouping's columns to their values as text.

    One Expand feeds one aggregate with partial sums, whatever the number of groupings; a null value of a grouping is told from a column that is not
    grouped by the grouping's number. ``distinct`` names counts of distinct values of columns: these values are first made distinct under all columns
    of the groupings, so that they, and not the rows, are repeated for each grouping. (A measure ``count_distinct`` repeats all rows.)
    """
    columns = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    code = {sum(b for c, b in bit.items() if c not in cols): name for name, cols in sets.items()}
    if len(code) < len(sets):
        raise ValueError("two groupings have the same columns")
    found = rows.groupingSets([[F.col(c) for c in cols] for cols in sets.values()], *columns).agg(F.grouping_id(*columns).cast("int").alias("_set"), *measures)
    if distinct:
        found = _with_distinct(rows, sets, columns, found, distinct)
    names = F.create_map(*(F.lit(x) for kv in code.items() for x in kv))
    keys = F.array(*(F.when(F.col("_set").bitwiseAND(b) == 0, F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c, b in bit.items()))
    return found.withColumn("statistic", names[F.col("_set")]).withColumn("keys", F.map_from_entries(F.filter(keys, lambda x: x.isNotNull()))).drop("_set", *columns)


def _with_distinct(rows: DataFrame, sets: dict[str, list[str]], columns: list[str], found: DataFrame, distinct: dict[str, str]) -> DataFrame:
    """``found``, the groups of ``by_sets``, with the counts of distinct values."""
    value = {f"_v{i}": c for i, c in enumerate(distinct.values())}
    alone = lambda v: F.struct(*((F.col(c) if k == v else F.lit(None).cast(rows.schema[c].dataType)).alias(k) for k, c in value.items()))
    few = rows.select(*columns, F.inline(F.array(*(alone(v) for v in value)))).distinct()
    seen = few.groupingSets([[F.col(c) for c in (*cols, *value)] for cols in sets.values()], *columns, *value).agg((F.grouping_id(*columns, *value) / (1 << len(value))).cast("int").alias("_set"))
    counts = seen.groupBy("_set", *columns).agg(*(F.count(v).alias(n) for v, n in zip(value, distinct, strict=True)))
    both = found.unionByName(counts, allowMissingColumns=True)
    measures = [c for c in found.columns if c not in ("_set", *columns)]
    return both.groupBy("_set", *columns).agg(*(F.first(c, ignorenulls=True).alias(c) for c in (*measures, *distinct)))
