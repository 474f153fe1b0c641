"""How the plans register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.fixed import RE2_FORMS

Query = Callable[[SparkSession, str], DataFrame]


def quoted(text: str) -> str:
    """A text or pattern as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def quoted_list(texts) -> str:
    return "[" + ", ".join(quoted(x) for x in texts) + "]"


def kinds_sql(column: str, kinds) -> str:
    """SQL for the names of all patterns that are found, in their order."""
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({column}, {quoted(RE2_FORMS.get(p, p))}) THEN {quoted(n)} END" for n, p in kinds) + "], lambda x: x IS NOT NULL)"


class Plans:
    """Queries of one subject with their SQL; a query gets a function that reads a table by name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
            self.queries[f.__name__].__doc__ = f.__doc__
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return keep
