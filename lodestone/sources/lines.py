"""Line rows: the ordered lines of texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept

#: Sizes of at most as many groups are broadcast.
GROUPS_AT_ONCE = 100_000


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_idx, line): lines that are not blank, numbered as they stand; a null text has none."""
    each = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_idx", "line"))
    return each.where(F.length(F.trim("line")) > 0)


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, line_idx, tag, line): text of headings, paragraphs and list items in their order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(?:h[1-6]|p|li)[ >].*?(?=<(?:h[1-6]|p|li)[ >]|$)"), F.lit(0))
    each = pages.select(key, F.posexplode(found).alias("line_idx", "block"))
    line = F.trim(F.regexp_replace(F.regexp_replace("block", r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return each.select(key, "line_idx", F.lower(F.regexp_extract("block", r"(?i)^<(h[1-6]|p|li)", 1)).alias("tag"), line.alias("line"))


def page_batches(rows: DataFrame, page: str, size: int) -> DataFrame:
    """``rows`` with the number of their batch of pages."""
    return rows.withColumn("batch", F.floor(F.col(page) / size))


def repeated_lines(lines: DataFrame, group: str, key: str, line: str, least: int = 3) -> DataFrame:
    """Lines that stand in ``least`` or more texts of a group, and in half of them."""
    size = lines.groupBy(group).agg(F.count_distinct(key).alias("n_texts"))
    n = lines.groupBy(group, line).agg(F.count_distinct(key).alias("n"))
    size = kept(size)
    small = size.count() <= GROUPS_AT_ONCE  # joined by shuffling, a few groups would put all distinct lines into as few tasks
    return n.where(F.col("n") >= least).join(F.broadcast(size) if small else size, group).where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("n_texts") / 2))).select(group, line, "n")
