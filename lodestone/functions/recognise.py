"""Recognisers of blocks and headings as column expressions: each gives a confidence, or null where it does not recognise.

A block is an array of lines; null and blank lines do not count. A heading is one line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .text import holds, partial_confidence, roman_3999, segments


def stripped(lines: Column) -> Column:
    """The lines without blanks at their ends, blank ones left out; null is no lines."""
    return F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def count_of(lines: Column, *patterns: str) -> Column:
    """Lines in which all patterns are found."""
    return F.size(F.filter(lines, lambda x: reduce(Column.__and__, [x.rlike(p) for p in patterns])))


def some(lines: Column, *patterns: str) -> Column:
    return F.exists(lines, lambda x: reduce(Column.__and__, [x.rlike(p) for p in patterns]))


def worded(lines: Column) -> Column:
    """Whether a line is more than numbers put into a formula."""
    return F.exists(lines, lambda x: ~x.rlike(V.NUMERIC_SUBSTITUTION))


def block_texts(lines: Column) -> Column:
    """What the recognisers read of a block: its lines joined, its first three, and both in lower case."""
    code, three = F.array_join(lines, "\n"), F.array_join(F.slice(lines, 1, 3), " ")
    return F.struct(lines.alias("lines"), code.alias("code"), F.lower(code).alias("low"), three.alias("three"), F.lower(three).alias("low3"))


def block_recognisers(lines: Column, texts: Column | None = None) -> dict[str, Column]:
    """Confidence of each recogniser for a block of stripped lines, in the order in which they are asked.

    ``texts``: their ``block_texts``, where these are at hand.
    """
    texts = block_texts(lines) if texts is None else texts
    code, low, three, low3 = (texts[c] for c in ("code", "low", "three", "low3"))
    n, first = F.size(lines), lambda k: F.array_join(F.slice(lines, 1, k), " ")
    whole = F.array_join(lines, " ")
    line_has = lambda p: code.rlike("(?m)" + p)  # noqa: E731 (a pattern that begins a line; true wherever it is found in one)
    equated = code.contains("=")
    formulas = F.when(equated, count_of(lines, V.VARIABLE_ONLY)).otherwise(0)
    more = F.when(line_has(V.CONTINUATION) | code.rlike(V.ALIGNMENT), F.size(F.filter(lines, lambda x: x.rlike(V.CONTINUATION) | x.rlike(V.ALIGNMENT)))).otherwise(0)
    reaction = holds(code, "->", "→", "⇌", "=>") & F.exists(lines, lambda x: x.rlike(V.CHEM_ARROW) & (F.regexp_count(x, F.lit(V.CHEM_TOKEN)) >= 2) & (F.regexp_count(x, F.lit(r"\p{L}")) >= F.regexp_count(x, F.lit(r"\d"))))
    economic = equated & F.exists(lines, lambda x: x.rlike(V.VARIABLE_ONLY) & (x.rlike(V.ECON_KEYWORDS) | x.rlike(V.ECON_LEFT)))
    solves, gives = line_has(V.SOLUTION), line_has(V.GIVEN_FIND)
    solved, given = solves & some(lines, V.SOLUTION), gives & some(lines, V.GIVEN_FIND)
    steps = F.when(
        line_has(V.STEP_MARKER) | solves | gives,
        F.aggregate(lines, F.lit(0), lambda s, x: s + F.when(~x.rlike(V.NUMERIC_SUBSTITUTION), sum((x.rlike(p).cast("int") for p in (V.STEP_MARKER, V.SOLUTION, V.GIVEN_FIND)), F.lit(0))).otherwise(0)),
    ).otherwise(0)
    followed = partial_confidence(steps, n, 0.75)
    headers = F.size(F.array_distinct(F.transform(F.regexp_extract_all(first(4), F.lit(V.JOURNAL_HEADER), F.lit(0)), lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("")))))
    headed = holds(low, "date", "particular", "debit", "credit", "amount") | code.rlike(r"(?i)l\.?\s?f")
    prose = (n >= 3) & (count_of(lines, V.PROSE_SENTENCE) > n * 0.5)
    says = lambda p, *words: holds(low3, *words) & three.rlike(p)
    programmed = reduce(Column.__or__, [holds(code, word) & code.rlike(p) if p else code.contains(word) for word, p in V.CODE_HINTS])
    return {
        "formula": F.when(formulas > 0, partial_confidence(formulas, n, 0.85)).when((more > 0) & (more >= F.floor(n / 2)), F.lit(0.85)),
        "math_identity": F.when(equated & some(lines, V.IDENTITY_SHAPE, V.TRIG_LOG), F.when(whole.rlike(V.IDENTITY_HINT), 0.9).otherwise(0.8)),
        "chemical_reaction": F.when(reaction, F.lit(0.8)),
        "economic_identity": F.when(economic, F.lit(0.8)),
        "procedure": F.when(steps > 0, F.when(solved | given, F.greatest(followed, F.lit(0.7))).otherwise(followed)),
        "algorithm": F.when(holds(low, "input", "output", "repeat", "while", "then", "algorithm", "pseudocode") & some(lines, V.ALGORITHM) & worded(lines), F.lit(0.78)),
        "journal_procedure": F.when((holds(low, "debit", "credit", "journal entry", "ledger") | code.rlike(r"(?i)[dc]r\b")) & some(lines, V.JOURNAL, "[a-zA-Z]"), F.lit(0.72)),
        "worked_example": F.when((solved | given) & worded(lines), F.when(solved & given, 0.8).otherwise(0.7)),
        "programming_syntax": F.when(programmed, F.lit(0.8)),
        "pseudocode": F.when(holds(low, "begin", "end", "procedure", "function", "input", "output") & code.rlike(V.PSEUDOCODE), F.lit(0.65)),
        "journal_format": F.when(headed & (headers >= 2), F.lit(0.75)),
        "ledger": F.when(holds(low, "ledger", "account") & whole.rlike(V.LEDGER_HEADER), F.lit(0.7)),
        "accounting_rule": F.when(holds(low, "debit", "credit") & some(lines, V.GOLDEN_RULE), F.lit(0.85)),
        "flowchart": F.when(says(V.FLOWCHART, "flow", "start", "end", "decision", "process"), F.lit(0.65)),
        "graph": F.when(says(V.GRAPH, "graph", "axis", "plot", "curve", "slope"), F.lit(0.6)),
        "circuit_diagram": F.when(says(V.CIRCUIT, "circuit", "resistor", "voltmeter", "ammeter", "capacitor", "battery", "ohm"), F.lit(0.6)),
        "concept_table": F.when(holds(low3, "comparison", "difference", "type", "classification", "versus", "vs") & first(2).rlike(V.CONCEPT_TABLE) & ~prose, F.lit(0.7)),
        "diagram_subtype": F.when(says(V.LIFE_CYCLE, "life", "stage", "phase"), 0.65).when(says(V.MAP, "map", "geographical", "topographic", "contour"), 0.6).when(says(V.ANATOMY, "anatomy", "structure of", "section"), 0.65),
        "figure_with_caption": F.when(first(1).rlike(V.FIGURE_CAPTION), F.lit(0.75)),
        "generic_visual": F.when(n > 0, F.lit(0.5)),
    }


def block_matches(lines: Column) -> Column:
    """The recognisers that recognise a block, its texts made once for all of them."""
    return F.transform(F.array(block_texts(lines)), lambda x: matched(block_recognisers(x["lines"], x)))[0]


def matched(found: dict[str, Column]) -> Column:
    """The recognisers that recognise, in their order, as structs (recognizer, confidence rounded to four places)."""
    return F.filter(F.array(*[F.struct(F.lit(name).alias("recognizer"), F.round(c, 4).alias("confidence")) for name, c in found.items()]), lambda r: r["confidence"].isNotNull())


def best_match(matches: Column) -> Column:
    """The match of the highest confidence, the first of equal ones; null for none."""
    return F.aggregate(matches, F.lit(None).cast("struct<recognizer:string,confidence:double>"), lambda best, r: F.when(best.isNull() | (r["confidence"] > best["confidence"]), r).otherwise(best))


def clean_heading(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def heading_recognisers(s: Column) -> dict[str, tuple[Column, Column]]:
    """(confidence, level) of each recogniser for a cleaned heading, in the order of their priorities."""
    bare = F.regexp_replace(s, r"[\s:.\-–—]+$", "")
    parts = segments(bare)
    deep = s.contains(".") & (F.length(s) <= 20) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,3}$"))
    chapter = rf"(?i)^(?:{'|'.join(V.CHAPTER_WORDS)})\s*[.:-]?\s*([A-Za-z0-9]+)\s*[.:-]?$"
    number = F.regexp_extract(s, chapter, 1)
    numbered = F.regexp_extract(s, V.NUMBERED_HEADING, 1)
    token = F.regexp_extract(s, "^([A-Za-z]+)([.)])?$", 1)
    marked = s.rlike("[.)]$")
    words = F.split(s, " ")
    core = F.transform(words, lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    cased = F.forall(F.transform(core, lambda w, i: (w != "") & (((i > 0) & F.lower(w).isin(*V.SMALL_TITLE_WORDS)) | w.rlike("^[A-Z]"))), lambda ok: ok)
    title = (F.length(s) >= 3) & (F.length(s) <= 60) & ~s.rlike("^[0-9]") & ~s.rlike("[.!?]$") & (F.size(words) <= 6) & cased
    long = F.when(F.size(words) <= 3, 1.0).otherwise(F.greatest(F.lit(0.6), 1.0 - 0.1 * (F.size(words) - 3)))
    return {
        "chapter_number": (F.when((F.length(s) <= 120) & s.rlike(chapter) & (number.rlike("^[0-9]+$") | roman_3999(number).isNotNull()), F.lit(0.95)), F.lit(1)),
        "hierarchical": (F.when(deep, F.lit(0.9)), F.least(F.size(parts), F.lit(6))),
        "numbered": (F.when((F.length(s) <= 6) & s.rlike(V.NUMBERED_HEADING), F.when(numbered == "0", 0.3).when(marked, 0.9).otherwise(0.855)), F.lit(2)),
        "roman": (F.when((token != "") & roman_3999(token).isNotNull(), F.when(F.length(token) == 1, 0.6).otherwise(0.9) * F.when(marked, 1.0).otherwise(0.97)), F.lit(2)),
        "alphabetic": (F.when((F.length(s) <= 4) & s.rlike("^[A-Za-z]$"), 0.55).when((F.length(s) <= 4) & s.rlike(r"^\(?[a-zA-Z][).]$"), 0.85), F.lit(3)),
        "chapter_title": (F.when(title, F.lit(0.7) * long * 0.9), F.lit(1)),
    }


def heading_matches(s: Column) -> Column:
    """Structs (recognizer, confidence, level, priority) in the order of priorities."""
    rows = [F.struct(F.lit(n).alias("recognizer"), F.round(c, 4).alias("confidence"), level.cast("int").alias("level"), F.lit(V.HEADING_PRIORITY[n]).alias("priority")) for n, (c, level) in heading_recognisers(s).items()]
    none = F.slice(F.array(rows[0]), 1, 0)
    return F.when(F.length(s) <= 120, F.filter(F.array(*rows), lambda r: r["confidence"].isNotNull())).otherwise(none)  # no recogniser takes a longer one


def numbering_system(s: Column) -> Column:
    """Of a number: DEVANAGARI, ARABIC, ROMAN or NONE."""
    return F.when(F.trim(s).rlike("[ऀ-ॿ]"), "DEVANAGARI").when(F.trim(s).rlike("^[0-9]+$"), "ARABIC").when(roman_3999(s).isNotNull(), "ROMAN").otherwise("NONE")
