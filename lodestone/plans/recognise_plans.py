"""Recognition of blocks and headings made of part names, orders and conversation lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import recognise as R
from .base import Plans, quoted
from .text_plans import LINES_SQL, filled, filled_sql, lines

P = Plans()

#: Blocks in which {n} stands for a name and {k} for a number; the sign | ends a line.
BLOCKS = (
    "v = u + a t| = {k} + 3", "a = b + c|x is the {n}|d = e - f", "= {k} + 1|&= 4|nothing", "sin(x) = 1 - cos(y)^2|an identity for the {n}", "log x = 2 ln y", "2H2 + O2 -> 2H2O|water and {n}", "A => {k}{k}{k}{k}1234567",
    "GDP = C + I + G|{n}", "NNP = a", "Step 1: take the {n}|{k} + 2|then stop|a line", "Solution|Given the {n}|find x|{k}", "input the {n}|repeat {k} times|output", "Dr. cash to {n} account|{k}", "def run(x):|  return {k}",
    "begin {n}|end", "Date|Particulars L.F.|Debit|Credit Amount|{k}", "debit the receiver|credit what goes out|{n}", "Flow chart: start {n}|process", "the x-axis and slope of {n}", "a resistor {k} ohm circuit", "difference between {n} and others|a|b",
    "types of {n}. The one|It is. And so|Yes. No", "life cycle of {n}", "contour map {k}", "cross-section of {n}", "Figure {k}: the {n}", "plain words of {n}|", " |  ", "journal entry {k}|ledger account|answer", "int x = {k};",
)
_LINES = f"list_filter(list_transform(string_split({filled_sql(BLOCKS, 'p_partkey', n='p_name', k='p_size')}, '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def _n(*patterns: str) -> str:
    return "len(list_filter(b, lambda x: " + " AND ".join(f"regexp_matches(x, {quoted(p)})" for p in patterns) + "))"


def _partial(matched: str, base: float) -> str:
    return f"CASE WHEN {matched} <= 0 THEN 0.0 WHEN {matched} >= len(b) THEN {base} ELSE greatest({base / 2}, {matched} / len(b) * {base}) END"


def _says(k: int, pattern: str) -> str:
    return f"regexp_matches(array_to_string(b[1:{k}], ' '), {quoted(pattern)})"


_WORDED = f"len(list_filter(b, lambda x: NOT regexp_matches(x, {quoted(V.NUMERIC_SUBSTITUTION)}))) > 0"
_MORE = f"len(list_filter(b, lambda x: regexp_matches(x, {quoted(V.CONTINUATION)}) OR regexp_matches(x, {quoted(V.ALIGNMENT)})))"
_STEPS = "CAST(coalesce(list_sum(list_transform(b, lambda x: CASE WHEN regexp_matches(x, " + quoted(V.NUMERIC_SUBSTITUTION) + ") THEN 0 ELSE " + " + ".join(f"CAST(regexp_matches(x, {quoted(p)}) AS INT)" for p in (V.STEP_MARKER, V.SOLUTION, V.GIVEN_FIND)) + " END)), 0) AS INT)"
_SOLVED, _GIVEN = f"{_n(V.SOLUTION)} > 0", f"{_n(V.GIVEN_FIND)} > 0"
_SQL = {
    "formula": f"CASE WHEN {_n(V.VARIABLE_ONLY)} > 0 THEN {_partial(_n(V.VARIABLE_ONLY), 0.85)} WHEN {_MORE} > 0 AND {_MORE} >= len(b) // 2 THEN 0.85 END",
    "math_identity": f"CASE WHEN {_n(V.IDENTITY_SHAPE, V.TRIG_LOG)} > 0 THEN CASE WHEN regexp_matches(array_to_string(b, ' '), {quoted(V.IDENTITY_HINT)}) THEN 0.9 ELSE 0.8 END END",
    "chemical_reaction": f"CASE WHEN len(list_filter(b, lambda x: regexp_matches(x, {quoted(V.CHEM_ARROW)}) AND len(regexp_extract_all(x, {quoted(V.CHEM_TOKEN)})) >= 2 AND len(regexp_extract_all(x, '\\p{{L}}')) >= len(regexp_extract_all(x, '\\d')))) > 0 THEN 0.8 END",
    "economic_identity": f"CASE WHEN len(list_filter(b, lambda x: regexp_matches(x, {quoted(V.VARIABLE_ONLY)}) AND (regexp_matches(x, {quoted(V.ECON_KEYWORDS)}) OR regexp_matches(x, {quoted(V.ECON_LEFT)})))) > 0 THEN 0.8 END",
    "procedure": f"CASE WHEN {_STEPS} > 0 THEN CASE WHEN {_SOLVED} OR {_GIVEN} THEN greatest(0.7, {_partial(_STEPS, 0.75)}) ELSE {_partial(_STEPS, 0.75)} END END",
    "algorithm": f"CASE WHEN {_n(V.ALGORITHM)} > 0 AND {_WORDED} THEN 0.78 END",
    "journal_procedure": f"CASE WHEN {_n(V.JOURNAL, '[a-zA-Z]')} > 0 THEN 0.72 END",
    "worked_example": f"CASE WHEN ({_SOLVED} OR {_GIVEN}) AND {_WORDED} THEN CASE WHEN {_SOLVED} AND {_GIVEN} THEN 0.8 ELSE 0.7 END END",
    "programming_syntax": f"CASE WHEN regexp_matches(array_to_string(b, chr(10)), {quoted(V.CODE_HINT)}) THEN 0.8 END",
    "pseudocode": f"CASE WHEN regexp_matches(array_to_string(b, chr(10)), {quoted(V.PSEUDOCODE)}) THEN 0.65 END",
    "journal_format": f"CASE WHEN len(list_distinct(list_transform(regexp_extract_all(array_to_string(b[1:4], ' '), {quoted(V.JOURNAL_HEADER)}), lambda x: replace(lower(x), ' ', '')))) >= 2 THEN 0.75 END",
    "ledger": f"CASE WHEN regexp_matches(array_to_string(b, ' '), {quoted(V.LEDGER_HEADER)}) THEN 0.7 END",
    "accounting_rule": f"CASE WHEN {_n(V.GOLDEN_RULE)} > 0 THEN 0.85 END",
    "flowchart": f"CASE WHEN {_says(3, V.FLOWCHART)} THEN 0.65 END",
    "graph": f"CASE WHEN {_says(3, V.GRAPH)} THEN 0.6 END",
    "circuit_diagram": f"CASE WHEN {_says(3, V.CIRCUIT)} THEN 0.6 END",
    "concept_table": f"CASE WHEN {_says(2, V.CONCEPT_TABLE)} AND NOT (len(b) >= 3 AND {_n(V.PROSE_SENTENCE)} > len(b) * 0.5) THEN 0.7 END",
    "diagram_subtype": f"CASE WHEN {_says(3, V.LIFE_CYCLE)} THEN 0.65 WHEN {_says(3, V.MAP)} THEN 0.6 WHEN {_says(3, V.ANATOMY)} THEN 0.65 END",
    "figure_with_caption": f"CASE WHEN {_says(1, V.FIGURE_CAPTION)} THEN 0.75 END",
    "generic_visual": "CASE WHEN len(b) > 0 THEN 0.5 END",
}
_STRIPPED = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_BLOCK = f"""(SELECT 'p' || p_partkey AS block_id, {_LINES} AS b FROM part UNION ALL SELECT 'd' || doc_id, {_STRIPPED} FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT 'c' || conv_id || '-' || turn, {_STRIPPED} FROM conversations WHERE text IS NOT NULL)"""
_MATCHES = " UNION ALL ".join(f"SELECT block_id, '{name}' AS recognizer, {i} AS nth, round(CAST({sql} AS DOUBLE), 4) AS confidence FROM {_BLOCK}" for i, (name, sql) in enumerate(_SQL.items()))


def blocks(t):
    """The lines of every document and conversation turn, and blocks made of part names, which have the shapes that those lack."""
    named = lambda a, *c: F.concat(F.lit(a), *c).alias("block_id")
    made = t("part").select(named("p", "p_partkey"), R.stripped(F.split(filled(BLOCKS, F.col("p_partkey"), n=F.col("p_name"), k=F.col("p_size")), r"\|")).alias("b"))
    text = lambda df, key: df.where("text is not null").select(key, R.stripped(F.split("text", "\n")).alias("b"))
    return made.union(text(t("documents"), named("d", "doc_id"))).union(text(t("conversations"), named("c", "conv_id", F.lit("-"), "turn")))


@P.add(f"SELECT block_id, recognizer, confidence FROM ({_MATCHES}) WHERE confidence IS NOT NULL")
def recognised_blocks(t):
    """Every recogniser that recognises a block, with its confidence."""
    return blocks(t).select("block_id", F.inline(R.block_matches(F.col("b"))))


@P.add(f"""SELECT block_id || '-eo' AS object_id, arg_min(recognizer, {{'c': -confidence, 'n': nth}}) AS recognizer, max(confidence) AS confidence, max(confidence) < 0.6 AS below_floor FROM ({_MATCHES}) WHERE confidence IS NOT NULL GROUP BY block_id""")
def recognised_objects(t):
    """One object of each block: its surest recogniser, the first of equal ones, and whether that is below the floor."""
    # as rows of a generator the recognisers are asked once; as a plain column they would be asked again by the filter and by each column drawn from it
    best = blocks(t).select("block_id", F.inline(F.filter(F.array(R.best_match(R.block_matches(F.col("b")))), lambda m: m.isNotNull())))
    return best.select(F.concat("block_id", F.lit("-eo")).alias("object_id"), "recognizer", "confidence", (F.col("confidence") < 0.6).alias("below_floor"))


HEADINGS = ("1.", "0", "{k}", "1.2.{k}", "IV", "iv.", "X)", "A", "(b)", "c)", "Chapter {k}", "Unit IV", "Lesson xyz", "The Living World", "Our Environment and the Sea of Stars", "plain words here", "1..2", "MMMM", "Structure: ", "", " 12 ", "Unit: 4.", "C", "DNA and RNA", "Ends with a Stop.", "1.2.3.4.5.6.7.", "12a", "Too Many Words In This One Title", "१२")
_TITLE = "length(s) BETWEEN 3 AND 60 AND NOT regexp_matches(s, '^[0-9]') AND NOT regexp_matches(s, '[.!?]$') AND len(w) <= 6 AND len(list_filter(range(1, len(w) + 1), lambda i: regexp_replace(w[i], '[^A-Za-z]', '', 'g') = '' OR NOT ((i > 1 AND lower(regexp_replace(w[i], '[^A-Za-z]', '', 'g')) IN (" + ", ".join(quoted(x) for x in V.SMALL_TITLE_WORDS) + ")) OR regexp_matches(regexp_replace(w[i], '[^A-Za-z]', '', 'g'), '^[A-Z]')))) = 0"
_CHAPTER = quoted(rf"(?i)^(?:{'|'.join(V.CHAPTER_WORDS)})\s*[.:-]?\s*([A-Za-z0-9]+)\s*[.:-]?$")
_ROMAN = lambda c: f"({c} <> '' AND regexp_matches({c}, {quoted(V.ROMAN_3999)}))"
_HEADING_SQL = {
    "chapter_number": (f"CASE WHEN regexp_matches(s, {_CHAPTER}) AND (regexp_matches(regexp_extract(s, {_CHAPTER}, 1), '^[0-9]+$') OR {_ROMAN(f'regexp_extract(s, {_CHAPTER}, 1)')}) THEN 0.95 END", "1"),
    "hierarchical": ("CASE WHEN contains(s, '.') AND length(s) <= 20 AND len(p) >= 2 AND len(list_filter(p, lambda x: NOT regexp_matches(x, '^[0-9]{1,3}$'))) = 0 THEN 0.9 END", "least(len(p), 6)"),
    "numbered": (f"CASE WHEN length(s) <= 6 AND regexp_matches(s, {quoted(V.NUMBERED_HEADING)}) THEN CASE WHEN regexp_extract(s, {quoted(V.NUMBERED_HEADING)}, 1) = '0' THEN 0.3 WHEN regexp_matches(s, '[.)]$') THEN 0.9 ELSE 0.855 END END", "2"),
    "roman": (f"CASE WHEN {_ROMAN('r')} THEN CASE WHEN length(r) = 1 THEN 0.6 ELSE 0.9 END * CASE WHEN regexp_matches(s, '[.)]$') THEN 1.0 ELSE 0.97 END END", "2"),
    "alphabetic": ("CASE WHEN regexp_matches(s, '^[A-Za-z]$') THEN 0.55 WHEN regexp_matches(s, '^\\(?[a-zA-Z][).]$') THEN 0.85 END", "3"),
    "chapter_title": (f"CASE WHEN {_TITLE} THEN 0.7 * CASE WHEN len(w) <= 3 THEN 1.0 ELSE greatest(0.6, 1.0 - 0.1 * (len(w) - 3)) END * 0.9 END", "1"),
}
_HEADING = f"(SELECT *, string_split(s, ' ') AS w, string_split_regex(regexp_replace(s, '[\\s:.\\-–—]+$', ''), '[.\\-]') AS p, regexp_extract(s, '^([A-Za-z]+)([.)])?$', 1) AS r FROM (SELECT line_id, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s FROM (SELECT 'o' || o_orderkey AS line_id, {filled_sql(HEADINGS, 'o_orderkey', k='o_custkey')} AS s FROM orders UNION ALL {LINES_SQL})))"
_HEADINGS = " UNION ALL ".join(f"SELECT line_id, '{n}' AS recognizer, {V.HEADING_PRIORITY[n]} AS priority, round(CAST({c} AS DOUBLE), 4) AS confidence, {level} AS level FROM {_HEADING}" for n, (c, level) in _HEADING_SQL.items())


def headings(t):
    """All lines of documents and conversations, and lines made of orders."""
    made = t("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("line_id"), filled(HEADINGS, F.col("o_orderkey"), k=F.col("o_custkey")).alias("s"))
    return made.union(lines(t)).select("line_id", R.clean_heading(F.col("s")).alias("s"))


@P.add(f"SELECT line_id, recognizer, confidence, CAST(level AS INT) AS level FROM ({_HEADINGS}) WHERE confidence IS NOT NULL")
def heading_matches(t):
    """All heading recognisers that recognise a line."""
    return headings(t).select("line_id", F.inline(R.heading_matches(F.col("s")))).drop("priority")


@P.add(f"""SELECT line_id, count(*) AS n_matches, arg_min(recognizer, priority) AS by_priority, arg_min(recognizer, {{'c': -confidence, 'p': priority}}) AS by_confidence, string_agg(recognizer, ',' ORDER BY confidence DESC, priority) AS all_matches
 FROM ({_HEADINGS}) WHERE confidence >= 0.5 GROUP BY 1""")
def heading_resolved(t):
    """What each strategy of conflict resolution makes of the matches over the threshold."""
    m = F.filter(R.heading_matches(F.col("s")), lambda r: r["confidence"] >= 0.5)
    ordered = lambda m: F.array_sort(F.transform(m, lambda r: F.struct((-r["confidence"]).alias("c"), r["priority"].alias("p"), r["recognizer"].alias("r"))))
    # as rows of a generator the recognisers are asked once, and not again by the filter and each column
    both = F.transform(F.filter(F.array(m), lambda m: F.size(m) > 0), lambda m: F.struct(m.alias("m"), ordered(m).alias("o")))
    rows = headings(t).select("line_id", F.inline(both))
    return rows.select("line_id", F.size("m").cast("long").alias("n_matches"), F.col("m")[0]["recognizer"].alias("by_priority"), F.col("o")[0]["r"].alias("by_confidence"), F.array_join(F.transform("o", lambda r: r["r"]), ",").alias("all_matches"))


@P.add(f"SELECT line_id, CASE WHEN regexp_matches(s, '[\\x{{0900}}-\\x{{097F}}]') THEN 'DEVANAGARI' WHEN regexp_matches(s, '^[0-9]+$') THEN 'ARABIC' WHEN {_ROMAN('s')} THEN 'ROMAN' ELSE 'NONE' END AS system FROM {_HEADING}")
def numbering_systems(t):
    return headings(t).select("line_id", R.numbering_system(F.col("s")).alias("system"))
