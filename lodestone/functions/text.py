"""Text and numeral functions as column expressions: all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CODE_CONSTRUCTS, CODE_LANGUAGES, CODE_WORDS, CROSS_REFERENCES, DEFINED_AFTER, DEFINED_BY_MEAN, DEFINED_DENOTES, DEFINED_FIRST, LIGATURES, ROMAN_3999, SCRIPTS, STEP_MARKER, STOP_WORDS, TERM_STOP_WORDS

BLANKS = r"[ \t\r\n]+"


def slug(c: Column, most: int = 60, default: str = "item") -> Column:
    """Lower-case ASCII letters and digits, other runs as one dash, no dash at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(s) > 0, F.substring(s, 1, most)).otherwise(F.lit(default))


def short_hash(c: Column, n: int = 6) -> Column:
    return F.substring(F.sha1(c), 1, n)


def make_id(c: Column) -> Column:
    """The slug and six hexadecimal digits of its sha1."""
    return F.concat(slug(c), F.lit("-"), short_hash(slug(c, 10_000)))


def urn(namespace: str, kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"urn:{namespace}:{kind}"), *[F.concat(F.lit(":"), slug(p)) for p in parts])


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5, from sha1 over the namespace's bytes and the name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def lookup_key(c: Column) -> Column:
    """Blanks collapsed, lower case, punctuation off both ends; null when nothing is left."""
    s = F.regexp_replace(F.lower(F.regexp_replace(c, BLANKS, " ")), r"^[ .,;:!?'\"()\-]+|[ .,;:!?'\"()\-]+$", "")
    return F.nullif(s, F.lit(""))


def collapse(c: Column) -> Column:
    """Horizontal blanks to one space, blanks around line ends gone, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n ?", "\n"))


def fix_punctuation(c: Column) -> Column:
    """No blank before closing punctuation, one after it before a letter, repeated commas to one."""
    s = F.regexp_replace(c, r"[ \t]+([,.;:!?])", "$1")
    s = F.regexp_replace(s, r",{2,}", ",")
    return F.regexp_replace(s, r"([,;:])([A-Za-z])", "$1 $2")


def split_case(c: Column) -> Column:
    """A blank where a capital follows a small letter or a digit."""
    return F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")


def expand_ligatures(c: Column) -> Column:
    for sign, letters in LIGATURES:
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return c


def clean_ocr(c: Column) -> Column:
    return collapse(split_case(fix_punctuation(collapse(expand_ligatures(c)))))


def tokens(c: Column) -> Column:
    """Distinct lower-case ASCII words and numbers."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def keywords(c: Column) -> Column:
    """Sorted distinct words over one character that are no stop words; other signs than letters, digits, blanks and _ are left out."""
    words = F.split(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9 _]", ""), " +")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))))


def cap_words(c: Column, n: int) -> Column:
    words = F.split(F.trim(c), BLANKS)
    return F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, F.lit("...")).otherwise(F.lit("")))


def count_in(c: Column, signs: str) -> Column:
    """Characters of a class such as ``[a-z]``, without making a list of them."""
    return F.length(F.regexp_replace(c, "[^" + signs[1:-1] + "]+", ""))


def script_counts(c: Column) -> Column:
    """A struct of the letters of a text and its characters of each script."""
    return F.struct(count_in(c, r"[\p{L}]").alias("letters"), *[count_in(c, signs).alias(n) for n, signs in SCRIPTS.items()])


def script_ratio(c: Column, script: str, counts: Column | None = None) -> Column:
    """Letters of a script over all letters; 0 without letters. ``counts``: the text's ``script_counts``, where these are at hand."""
    counts = script_counts(c) if counts is None else counts
    return F.when(counts["letters"] > 0, counts[script] / counts["letters"]).otherwise(F.lit(0.0))


def detect_script(c: Column, least: float = 0.3, counts: Column | None = None) -> Column:
    """The script with the largest ratio of at least ``least``; the first listed wins ties. ``counts``: as for ``script_ratio``."""
    ratios = [(n, script_ratio(c, n, counts)) for n in SCRIPTS]
    top = F.greatest(*[r for _, r in ratios])
    out = F.lit(None).cast("string")
    for name, r in reversed(ratios):
        out = F.when((r == top) & (top >= least), F.lit(name)).otherwise(out)
    return out


def holds(text: Column, *words: str) -> Column:
    """Whether any of the words stands in the text: far cheaper than a pattern, which is asked only where its words are."""
    return reduce(Column.__or__, [text.contains(w) for w in words])


def first_kind(c: Column, kinds: tuple[tuple[str, str], ...], low: Column) -> Column:
    """The first named pattern that is found; ``low``: the text in lower case."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(kinds):
        out = F.when(holds(low, *CODE_WORDS[name]) & c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def is_step(c: Column) -> Column:
    """Whether a line begins as a step does."""
    return F.coalesce(c.rlike(STEP_MARKER), F.lit(False))


def code_language(c: Column, low: Column | None = None) -> Column:
    return F.coalesce(first_kind(c, CODE_LANGUAGES, F.lower(c) if low is None else low), F.lit("other"))


def found_kinds(c: Column, kinds: tuple[tuple[str, str], ...], low: Column) -> Column:
    """Sorted names of all patterns that are found; ``low``: the text in lower case."""
    return F.array_sort(F.array_compact(F.array(*[F.when(holds(low, *CODE_WORDS[n]) & c.rlike(p), F.lit(n)) for n, p in kinds])))


def code_constructs(c: Column, low: Column | None = None) -> Column:
    return found_kinds(c, CODE_CONSTRUCTS, F.lower(c) if low is None else low)


def cross_references(c: Column) -> Column:
    """All references in the order of the patterns, as ``kind: mention``."""
    named = lambda kind: lambda mention: F.concat(F.lit(f"{kind}: "), F.trim(mention))
    return F.flatten(F.array(*[F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), named(kind)) for kind, p in CROSS_REFERENCES]))


def term_is_valid(c: Column) -> Column:
    """Two characters or more, no digit first, no stop word, six words at most."""
    return F.coalesce((F.length(c) >= 2) & ~c.rlike(r"^\d") & ~F.lower(c).isin(*TERM_STOP_WORDS) & (F.size(F.split(c, r"\s+")) <= 6), F.lit(False))


def defined_term(c: Column) -> Column:
    """The term that a sentence defines, by the first of the four forms that is found, if it is a valid one."""
    found = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")) for p in (DEFINED_FIRST, DEFINED_AFTER, DEFINED_DENOTES, DEFINED_BY_MEAN)])
    return F.when(term_is_valid(found), found)


def roman(c: Column) -> Column:
    """Value of a strict Roman numeral up to 4999, else null."""
    up = F.upper(F.trim(c))
    ok = up.rlike("^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (F.length(up) > 0)
    one = lambda s, v: (F.length(up) - F.length(F.replace(up, F.lit(s), F.lit("")))) / len(s) * v
    value = sum((one(s, v) for s, v in (("M", 1000), ("D", 500), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1))), F.lit(0.0))
    less = sum((one(s, v) for s, v in (("CM", 200), ("CD", 200), ("XC", 20), ("XL", 20), ("IX", 2), ("IV", 2))), F.lit(0.0))
    return F.when(ok, (value - less).cast("int"))


def roman_3999(c: Column) -> Column:
    """As ``roman``, up to 3999."""
    return F.when(F.trim(c).rlike(ROMAN_3999), roman(c))


def to_roman(c: Column) -> Column:
    """The Roman numeral of 1 to 3999, else null."""
    out = F.lit("")
    for base, one, five, ten in ((1000, "M", "", ""), (100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X")):
        d = F.floor(c / base) % 10
        digits = F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)])
        out = F.concat(out, F.element_at(digits, (d + 1).cast("int")))
    return F.when(c.between(1, 3999), out)


def devanagari(c: Column) -> Column:
    """Value of a number in Devanagari digits, else null; blanks around it do not matter."""
    return F.when(F.trim(c).rlike("^[०-९]+$"), F.translate(F.trim(c), "०१२३४५६७८९", "0123456789").cast("int"))


def is_arabic(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("^[0-9]+$"), F.lit(False))


def is_devanagari_sign(c: Column) -> Column:
    return F.coalesce(c.rlike("^[\u0900-\u097F]$"), F.lit(False))


def numeral(c: Column) -> Column:
    """A number in ASCII or Devanagari digits, in ASCII digits; else null."""
    return F.when(F.trim(c).rlike("^([0-9]+|[०-९]+)$"), F.translate(F.trim(c), "०१२३४५६७८९", "0123456789"))


def marker_index(c: Column) -> Column:
    """1 for ``a)``, ``(a)`` or ``A.``, and so on; else null."""
    letter = F.regexp_extract(F.trim(c), r"^\(?([a-zA-Z])[).]$", 1)
    return F.when(letter != "", F.ascii(F.lower(letter)) - 96)


def segments(c: Column) -> Column:
    """The parts of a number such as 1.2.3 or 2-1-a (two at least, none empty), else null."""
    parts = F.split(F.trim(c), r"[.\-]")
    return F.when((F.size(parts) >= 2) & ~F.exists(parts, lambda p: p == ""), parts)


def compare_numbers(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two such numbers: parts of digits as numbers, others as lower-case text, a shorter one first; null if either is none."""
    x, y = segments(a), segments(b)
    one = lambda p, q: F.when(p.isNull() | q.isNull() | (p == q), 0).when(p.rlike("^[0-9]+$") & q.rlike("^[0-9]+$"), F.when(p.cast("decimal(38,0)") < q.cast("decimal(38,0)"), -1).otherwise(1)).otherwise(F.when(F.lower(p) < F.lower(q), -1).otherwise(1))
    first = F.element_at(F.filter(F.zip_with(x, y, one), lambda s: s != 0), 1)
    both = F.size(F.filter(F.zip_with(x, y, one), lambda s: s != 0))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("int")).when(both > 0, first).otherwise(F.signum(F.size(x) - F.size(y)).cast("int"))


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def combined_confidence(base: Column, *scores: Column) -> Column:
    """The product of the base and all scores, each held to 0..1."""
    for s in scores:
        base = base * clamped(s)
    return clamped(base)


def number_depth(c: Column) -> Column:
    """Segments of a number such as 1.2.3 (two at least), else null."""
    parts = F.filter(F.split(F.trim(c), r"[.\-]"), lambda p: p != "")
    return F.when(c.rlike(r"^[ ]*[0-9A-Za-z]+([.\-][0-9A-Za-z]+)+[ ]*$"), F.size(parts))


def partial_confidence(matched: Column, total: Column, base: float) -> Column:
    """0 for no match, the base for all, else the share of the base, half of it at least."""
    return F.when(matched <= 0, F.lit(0.0)).when(matched >= total, F.lit(base)).otherwise(F.greatest(F.lit(base / 2), matched / total * base))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.4, "medium").when(c.isNotNull(), "low")


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes given as column prefixes (x0, y0, x1, y1)."""
    p = lambda s, n: F.col(f"{s}_{n}")
    w = F.greatest(F.lit(0.0), F.least(p(a, "x1"), p(b, "x1")) - F.greatest(p(a, "x0"), p(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(p(a, "y1"), p(b, "y1")) - F.greatest(p(a, "y0"), p(b, "y0")))
    area = lambda s: (p(s, "x1") - p(s, "x0")) * (p(s, "y1") - p(s, "y0"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))
