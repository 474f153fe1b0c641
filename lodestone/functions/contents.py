"""Lines of tables of contents by their shape, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page tokens, item numbers, dotted leaders and the bounds of a row.
PAGE_TOKEN = r"^(?:\d{1,4}|(?i:[ivxlcdm]{1,6}))$"
LEADING_NUMBER = r"^(?:[^\d\s]+\s+)?(\d+)(?:\.\d+)*[.\-:)]?\s+\S"
ENTRY_NUMBER = r"^(?:[^\d\s]+\s+)?0*1?\d{1,2}(?:\.\d+)*[.\-:)]?\s+\S"  # LEADING_NUMBER with a number below 200
RUN_NUMBER = r"^(?:[^\d\s]+\s+)?(\d+)"
DOTTED_LEADER = r"(?:\.\s*){3,}"
SENTENCE_END = ".,;:?!"
LEAST_BODY, MOST_HEADING = 3, 60


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_contents_heading(text: Column) -> Column:
    """A line that names a table of contents."""
    low = F.lower(stripped(text))
    return low.startswith("content") | (low == "table of contents")


def page_token(text: Column) -> Column:
    """The last word, if it looks like a page number and three characters or more stand before it; else null."""
    return _token(stripped(text))


def _token(s: Column) -> Column:
    last = F.regexp_extract(s, r"\s(\S+)$", 1)
    body = F.regexp_replace(F.regexp_replace(s, r"\s+\S+$", ""), r"^[ .]+|[ .]+$", "")
    return F.when((last != "") & last.rlike(PAGE_TOKEN) & (F.length(F.regexp_replace(body, r"\s+", " ")) >= LEAST_BODY), last)


def is_entry(text: Column) -> Column:
    """A row with a page number and either an item number below 200 or a dotted leader."""
    return _entry(stripped(text))


def _entry(s: Column) -> Column:
    return (s.rlike(ENTRY_NUMBER) | s.rlike(DOTTED_LEADER)) & _token(s).isNotNull()


def is_heading_shaped(text: Column) -> Column:
    """Short, no entry, and without the mark of a sentence's end."""
    return _short(stripped(text)) & ~is_entry(text)


def _short(s: Column) -> Column:
    return (s != "") & (F.length(s) <= MOST_HEADING) & ~F.lit(SENTENCE_END).contains(F.right(s, F.lit(1)))


def row_kind(text: Column) -> Column:
    """'entry', 'filler' (what may stand between two entries) or 'other'."""
    return kind_of_stripped(stripped(text))


def kind_of_stripped(s: Column) -> Column:
    """``row_kind`` of a line without white space at its ends; whether it is an entry is asked once."""
    lone = s.rlike(r"^\d{1,4}$") | s.rlike(r"^(?i:[ivxlcdm]{1,6})$")
    low = F.lower(s)
    return F.when(_entry(s), "entry").when(low.startswith("content") | (low == "table of contents"), "other").when((s == "") | _short(s) | lone, "filler").otherwise("other")
