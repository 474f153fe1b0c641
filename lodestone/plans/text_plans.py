"""Search and text queries over documents, conversations, parts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as X
from ..operators import search as S
from .base import Plans, kinds_sql, quoted, quoted_list

P = Plans()
QUERY = ["the", "and", "of"]
_SCORED = """SELECT doc_id, len(list_intersect(['and','of','the'], t)) / greatest(3, len(t)) AS score
 FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM documents)"""
_STOP = ", ".join(quoted(w) for w in V.STOP_WORDS)


@P.add(f"SELECT doc_id, score FROM ({_SCORED}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def search_topk(t):
    """The ten documents that share most tokens with a query."""
    return S.search(t("documents"), "doc_id", "text", QUERY)


@P.add(f"SELECT count(*) AS total_found FROM ({_SCORED}) WHERE score > 0")
def search_total(t):
    return S.found(t("documents"), "text", QUERY)


@P.add(f"""SELECT keyword, count(*) AS n_rows, min(conv_id) AS first_id, max(conv_id) AS last_id FROM (
 SELECT conv_id, turn, unnest(list_distinct(string_split_regex(regexp_replace(lower(trim(text, ' ')), '[^a-z0-9 _]', '', 'g'), ' +'))) AS keyword FROM conversations)
 WHERE length(keyword) > 1 AND keyword NOT IN ({_STOP}) GROUP BY keyword""")
def keyword_postings(t):
    return S.postings(t("conversations"), "conv_id", "text")


@P.add("""SELECT c_custkey, round(least(1.0, greatest(0.0, 0.7 * ((c_acctbal + 1000) / 11000) + 0.3 * least(coalesce(n, 0), 10) / 10)), 4) AS search_rank
 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def search_rank(t):
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = t("customer")
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", S.search_rank((F.col("c_acctbal") + 1000) / 11000, F.coalesce("n", F.lit(0))).alias("search_rank"))


_SLUG = "trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-')"


@P.add(f"SELECT p_partkey, substr({_SLUG}, 1, 60) AS slug, substr({_SLUG}, 1, 60) || '-' || substr(sha1({_SLUG}), 1, 6) AS id FROM (SELECT p_partkey, p_brand || ' / ' || p_name || '!' AS s FROM part)")
def slug_ids(t):
    """Slugs and ids of part names."""
    s = F.concat("p_brand", F.lit(" / "), "p_name", F.lit("!"))
    return t("part").select("p_partkey", X.slug(s).alias("slug"), X.make_id(s).alias("id"))


@P.add("SELECT n_nationkey, 'urn:tpch:nation:' || replace(lower(r_name), ' ', '-') || ':' || replace(lower(n_name), '_', '-') AS urn FROM nation JOIN region ON n_regionkey = r_regionkey")
def urns(t):
    n, r = t("nation"), t("region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", X.urn("tpch", "nation", F.col("r_name"), F.col("n_name")).alias("urn"))


@P.add(r"""SELECT doc_id, md5(nullif(regexp_replace(lower(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), '^[ .,;:!?''"()\-]+|[ .,;:!?''"()\-]+$', '', 'g'), '')) AS key_md5 FROM documents""")
def lookup_keys(t):
    return t("documents").select("doc_id", F.md5(X.lookup_key(F.col("text"))).alias("key_md5"))


@P.add(r"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(s, '[ \t]+([,.;:!?])', '\1', 'g'), ',{2,}', ',', 'g'), '([,;:])([A-Za-z])', '\1 \2', 'g')) AS fixed_md5
 FROM (SELECT conv_id, turn, replace(text, ', ', ' ,,') AS s FROM conversations)""")
def ocr_punctuation(t):
    s = F.replace(F.col("text"), F.lit(", "), F.lit(" ,,"))
    return t("conversations").select("conv_id", "turn", F.md5(X.fix_punctuation(s)).alias("fixed_md5"))


@P.add(r"SELECT c_custkey, regexp_replace(c_mktsegment || 'aB1C' || c_name, '([a-z0-9])([A-Z])', '\1 \2', 'g') AS split FROM customer")
def case_split(t):
    return t("customer").select("c_custkey", X.split_case(F.concat("c_mktsegment", F.lit("aB1C"), "c_name")).alias("split"))


@P.add(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'))) AS collapsed_md5 FROM documents")
def whitespace_collapse(t):
    return t("documents").select("doc_id", F.md5(X.collapse(F.col("text"))).alias("collapsed_md5"))


@P.add(r"""SELECT item_id, array_to_string(w[1:20], ' ') || CASE WHEN len(w) > 20 THEN '...' ELSE '' END AS capped FROM (SELECT item_id, string_split_regex(trim(text), '[ \t\r\n]+') AS w FROM benchmark)""")
def word_cap(t):
    return t("benchmark").select("item_id", X.cap_words(F.col("text"), 20).alias("capped"))


_RATIO = r"""SELECT doc_id, n, CASE WHEN n > 0 THEN len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]')) / n ELSE 0.0 END AS latin,
 CASE WHEN n > 0 THEN len(regexp_extract_all(text, '[Α-Ωα-ω]')) / n ELSE 0.0 END AS greek FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\p{L}')) AS n FROM documents)"""


@P.add(f"SELECT doc_id, round(latin, 4) AS latin, CASE WHEN latin >= 0.3 AND latin >= greek THEN 'latin' WHEN greek >= 0.3 THEN 'greek' END AS script FROM ({_RATIO})")
def script_detect(t):
    """Share of Latin letters, and the script of a text."""
    counted = t("documents").select("doc_id", "text", F.inline(F.array(F.struct(X.script_counts(F.col("text")).alias("n")))))  # as a generator's row, made once
    text, n = F.col("text"), F.col("n")
    return counted.select("doc_id", F.round(X.script_ratio(text, "latin", n), 4).alias("latin"), X.detect_script(text, counts=n).alias("script"))


#: All lines of documents and of conversation turns, as they stand.
LINES_SQL = """SELECT 'd' || doc_id || ':' || i AS line_id, x[i + 1] AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)
 UNION ALL SELECT 'c' || conv_id || '-' || turn || ':' || i, x[i + 1] FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM conversations)"""
#: Their distinct words.
WORDS_SQL = "SELECT DISTINCT split_part(line_id, ':', 1) || ':' || w AS line_id, w AS s FROM (SELECT line_id, unnest(string_split(s, ' ')) AS w FROM (" + LINES_SQL + "))"


def lines(t):
    each = lambda table, *key: t(table).select(F.concat(*key).alias("key"), F.posexplode(F.split("text", "\n")).alias("i", "s")).select(F.concat("key", F.lit(":"), "i").alias("line_id"), "s")
    return each("documents", F.lit("d"), "doc_id").union(each("conversations", F.lit("c"), "conv_id", F.lit("-"), "turn"))


def line_words(t):
    """The distinct words of each key's lines: a text's own are made distinct where it stands, only those of keys with several texts meet."""
    of = lambda table, *key: t(table).select(F.split_part(F.concat(*key), F.lit(":"), F.lit(1)).alias("key"), "text")
    texts = of("documents", F.lit("d"), "doc_id").union(of("conversations", F.lit("c"), "conv_id", F.lit("-"), "turn"))
    words = lambda some: some.select("key", F.explode(F.array_distinct(F.split(F.translate("text", "\n", " "), " "))).alias("s"))
    several = texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 or key is null").select("key")
    same = F.col("a.key").eqNullSafe(F.col("b.key"))
    of_one = words(texts.alias("a").join(several.alias("b"), same, "left_anti"))
    of_more = words(texts.alias("a").join(several.alias("b"), same, "left_semi")).distinct()
    return of_one.union(of_more).select(F.concat("key", F.lit(":"), "s").alias("line_id"), "s")


#: Sentences in which {n} stands for a name: the lines of the tables lack such shapes, so rows made of names stand beside them.
DEFINING = ("By {n} we mean a thing.", "{N} is defined as a thing.", "It is called the {n}, and so on.", "{N} denotes a thing.", "No term in {n} here", "They are known as which.", "it is defined as {n}", "As {n} are referred to as 7 up", "{N} is defined as what is called a {n}; so it is")
_NAMED = "upper(substr(p_name, 1, 1)) || substr(p_name, 2)"


def filled(templates, key, **values):
    """The template of each row's key, with the values put in."""
    out = F.element_at(F.array(*[F.lit(x) for x in templates]), (key % len(templates) + 1).cast("int"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def filled_sql(templates, key, **values):
    out = f"list_extract({quoted_list(templates)}, CAST({key} % {len(templates)} + 1 AS INT))"
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', CAST({value} AS VARCHAR))"
    return out


_FORMS = [V.DEFINED_FIRST, V.DEFINED_AFTER, V.DEFINED_DENOTES, V.DEFINED_BY_MEAN]


@P.add(f"""SELECT line_id, CASE WHEN length(t) >= 2 AND NOT regexp_matches(t, '^\\d') AND lower(t) NOT IN ({", ".join(quoted(w) for w in V.TERM_STOP_WORDS)}) AND len(string_split_regex(t, '\\s+')) <= 6 THEN t END AS term
 FROM (SELECT line_id, coalesce({", ".join(f"nullif(trim(regexp_extract(s, {quoted(f)}, 1)), '')" for f in _FORMS)}) AS t FROM (SELECT 'p' || p_partkey AS line_id, {filled_sql(DEFINING, "p_partkey", n="p_name", N=_NAMED)} AS s FROM part UNION ALL {LINES_SQL}))""")
def definition_terms(t):
    """Terms of definitions in all lines, and in sentences made of part names."""
    named = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    made = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("line_id"), filled(DEFINING, F.col("p_partkey"), n=F.col("p_name"), N=named).alias("s"))
    return made.union(lines(t)).select("line_id", X.defined_term(F.col("s")).alias("term"))


REFERRING = ("As shown in Table {p}, and see the figure {l}.{s}.", "Using the above formula for {p}; according to the previous definition.", "As discussed earlier, referring to figure {p}", "Table {p} and Fig. {s} say nothing", "from the  following equation, as explained above, see table", "see Figure {l} see figure {s}")
_FOUND = ", ".join(f"list_transform(regexp_extract_all(s, {quoted(p)}), lambda x: {quoted(k + ': ')} || trim(x))" for k, p in V.CROSS_REFERENCES)


@P.add(f"""SELECT line_id, array_to_string(flatten([{_FOUND}]), ',') AS refs FROM (SELECT 'l' || l_orderkey || ':' || l_linenumber AS line_id, {filled_sql(REFERRING, "l_suppkey", p="l_partkey", l="l_linenumber", s="l_suppkey")} AS s FROM lineitem UNION ALL {LINES_SQL})""")
def cross_references(t):
    """References to other parts of a text in all lines, and in lines made of order lines."""
    s = filled(REFERRING, F.col("l_suppkey"), p=F.col("l_partkey"), l=F.col("l_linenumber"), s=F.col("l_suppkey"))
    made = t("lineitem").select(F.concat(F.lit("l"), "l_orderkey", F.lit(":"), "l_linenumber").alias("line_id"), s.alias("s"))
    return made.union(lines(t)).select("line_id", F.array_join(X.cross_references(F.col("s")), ",").alias("refs"))


STEPS = ("Step {k}: heat it", "{k}. heat it", "b) heat it", "Firstly heat it", "then heat it", "Then, nothing", "finally it is done", "lastly {k}", "heat it next", "step it", "First-rate", "  next: {k}", "12 heat", "theneverything")


@P.add(f"SELECT line_id, regexp_matches(s, {quoted(V.STEP_MARKER)}) AS is_step FROM (SELECT 'e' || event_id AS line_id, {filled_sql(STEPS, 'event_id', k='user_id')} AS s FROM events UNION ALL {LINES_SQL})")
def step_markers(t):
    """Which lines begin a step: all lines, and lines made of events."""
    made = t("events").select(F.concat(F.lit("e"), "event_id").alias("line_id"), filled(STEPS, F.col("event_id"), k=F.col("user_id")).alias("s"))
    return made.union(lines(t)).select("line_id", X.is_step(F.col("s")).alias("is_step"))


#: A word's border is at no letter, whatever its script; in RE2 it is at ASCII letters only.
_ASCII = "regexp_replace(s, '[À-ÖØ-öø-ɏ]', 'x', 'g')"
CODE = ("if x == {k}:\n    return x", "def run{k}(x):\n  print(x)", "public static void main() {{ System.out.println({k}); }}", "const a = {k}; console.log(a)", "SELECT a FROM t WHERE b <> {k}", "#include <x.h>\nint y{k};", "begin\n repeat {k} end", "plain words {k}", "// a {k}\nclass A", "try { x = y } catch (e) { throw e }", "a <= {k} and b != 3", "import os\nfor i in x: do")


@P.add(f"SELECT line_id, array_to_string(list_sort({kinds_sql('s', V.CODE_CONSTRUCTS)}), ',') AS constructs, coalesce(list_extract({kinds_sql('s', V.CODE_LANGUAGES)}, 1), 'other') AS code_language FROM (SELECT 'e' || event_id AS line_id, {filled_sql(CODE, 'event_id', k='user_id')} AS s FROM events UNION ALL SELECT line_id, {_ASCII} FROM ({LINES_SQL}) UNION ALL SELECT 'h' || page_id, {_ASCII} FROM (SELECT page_id, html AS s FROM pages))")
def code_constructs(t):
    """Constructs and the language of program text: of all lines and whole pages, and of texts made of events."""
    s = filled(CODE, F.col("event_id"), k=F.col("user_id"))
    made = t("events").select(F.concat(F.lit("e"), "event_id").alias("line_id"), s.alias("s")).union(lines(t)).union(t("pages").select(F.concat(F.lit("h"), "page_id"), "html"))
    low = made.withColumn("low", F.lower("s"))
    return low.select("line_id", F.array_join(X.code_constructs(F.col("s"), F.col("low")), ",").alias("constructs"), X.code_language(F.col("s"), F.col("low")).alias("code_language"))


ROMANS = ("XIV", "IIX", "MCMXCIX", "iv", "", "MMMDCCCLXXXVIII", "MMMMCMXCIX", "VX", " xl ", "CDXLIV", "IIII", "D", "mmmm", "LXXX", "abc")
_DIGITS = "map {'I': 1, 'V': 5, 'X': 10, 'L': 50, 'C': 100, 'D': 500, 'M': 1000}"
_ROMAN = f"CAST(list_sum(list_transform(range(1, length(u) + 1), lambda i: {_DIGITS}[substr(u, i, 1)] * CASE WHEN coalesce({_DIGITS}[substr(u, i + 1, 1)], 0) > {_DIGITS}[substr(u, i, 1)] THEN -1 ELSE 1 END)) AS INT)"


@P.add(f"""SELECT line_id, CASE WHEN u <> '' AND regexp_matches(u, '^M{{0,4}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$') THEN {_ROMAN} END AS value,
 CASE WHEN u <> '' AND regexp_matches(u, {quoted(V.ROMAN_3999)}) THEN {_ROMAN} END AS value_3999 FROM (SELECT line_id, upper(trim(s)) AS u FROM (SELECT 'p' || p_partkey AS line_id, {filled_sql(ROMANS, 'p_partkey')} AS s FROM part UNION ALL {WORDS_SQL}))""")
def roman_numerals(t):
    """Strict Roman numerals up to 4999 and up to 3999; others have no value."""
    made = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("line_id"), filled(ROMANS, F.col("p_partkey")).alias("s"))
    return made.union(line_words(t)).select("line_id", X.roman(F.col("s")).alias("value"), X.roman_3999(F.col("s")).alias("value_3999"))


NUMBERS = ("1.2.{k}", "12", " {k} ", "१२", "(b)", "C.", "a)", "1..2", "2-1-a", "IV", "1.2", "1.2.50.{k}", "", "1.10.{k}", "क", "1.A.2", "12a")
_SEGMENTS = r"CASE WHEN len(p) >= 2 AND NOT list_contains(p, '') THEN p END"
_COMPARED = """CASE WHEN x IS NULL THEN NULL ELSE coalesce(list_extract(list_filter(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: CASE WHEN x[i] = y[i] THEN 0 WHEN regexp_matches(x[i], '^[0-9]+$') AND regexp_matches(y[i], '^[0-9]+$') THEN CASE WHEN TRY_CAST(x[i] AS HUGEINT) < TRY_CAST(y[i] AS HUGEINT) THEN -1 ELSE 1 END WHEN lower(x[i]) < lower(y[i]) THEN -1 ELSE 1 END), lambda s: s <> 0), 1), sign(len(x) - len(y))) END"""
_ROMAN_OF = " || ".join(f"list_extract({quoted_list(('', a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c))}, CAST(r // {n} % 10 + 1 AS INT))" for n, a, b, c in ((1000, "M", "", ""), (100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X")))


@P.add(f"""SELECT o_orderkey, regexp_matches(trim(s), '^[0-9]+$') AS is_arabic, regexp_matches(s, '^[\\x{{0900}}-\\x{{097F}}]$') AS is_devanagari, CASE WHEN regexp_matches(trim(s), '^([0-9]+|[०-९]+)$') THEN translate(trim(s), '०१२३४५६७८९', '0123456789') END AS number,
 CASE WHEN regexp_matches(trim(s), '^[०-९]+$') THEN CAST(translate(trim(s), '०१२३४५६७८९', '0123456789') AS INT) END AS devanagari, CASE WHEN regexp_matches(trim(s), '^\\(?([a-zA-Z])[).]$') THEN ascii(lower(regexp_extract(trim(s), '^\\(?([a-zA-Z])[).]$', 1))) - 96 END AS marker_index,
 coalesce(len(x), -1) AS n_segments, CAST({_COMPARED} AS INT) AS compared, CASE WHEN r BETWEEN 1 AND 3999 THEN {_ROMAN_OF} END AS roman, round(0.9 * greatest(0.0, least(1.0, r / 4000)) * greatest(0.0, least(1.0, 1.5 - r / 8000)), 6) AS combined
 FROM (SELECT *, {_SEGMENTS} AS x, ['1', '2', '50'] AS y FROM (SELECT o_orderkey, o_custkey % 4200 AS r, s, string_split_regex(trim(s), '[.\\-]') AS p FROM (SELECT *, {filled_sql(NUMBERS, 'o_orderkey', k='o_custkey')} AS s FROM orders)))""")
def numerals(t):
    """Numbers of headings: digits, markers, parts, their order, Roman numerals and combined confidence."""
    s, r = filled(NUMBERS, F.col("o_orderkey"), k=F.col("o_custkey")), F.col("o_custkey") % 4200
    combined = F.round(X.combined_confidence(F.lit(0.9), r / 4000, 1.5 - r / 8000), 6)
    return t("orders").select("o_orderkey", X.is_arabic(s).alias("is_arabic"), X.is_devanagari_sign(s).alias("is_devanagari"), X.numeral(s).alias("number"), X.devanagari(s).alias("devanagari"), X.marker_index(s).alias("marker_index"), F.coalesce(F.size(X.segments(s)), F.lit(-1)).alias("n_segments"), X.compare_numbers(s, F.lit("1.2.50")).alias("compared"), X.to_roman(r).alias("roman"), combined.alias("combined"))


@P.add(f"SELECT l_orderkey, l_linenumber, CASE WHEN len(p) >= 2 AND NOT list_contains(p, '') THEN len(p) END AS depth FROM (SELECT l_orderkey, l_linenumber, string_split_regex(trim({filled_sql(NUMBERS, 'l_suppkey', k='l_partkey')}), '[.\\-]') AS p FROM lineitem)")
def number_depth(t):
    """Parts of hierarchical numbers."""
    return t("lineitem").select("l_orderkey", "l_linenumber", F.size(X.segments(filled(NUMBERS, F.col("l_suppkey"), k=F.col("l_partkey")))).alias("depth"))


_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(n_name))"


@P.add(f"""SELECT n_nationkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || list_extract(['8', '9', 'a', 'b'], CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS INT)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT n_nationkey, {_SHA} AS h FROM nation)""")
def uuid5_ids(t):
    """Version 5 ids of nations."""
    return t("nation").select("n_nationkey", X.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.col("n_name")).alias("id"))


@P.add("SELECT n_nationkey, sha256('{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}') AS fingerprint FROM nation")
def fingerprints(t):
    """sha256 of rows as JSON with sorted keys."""
    body = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    return t("nation").select("n_nationkey", F.sha2(body, 256).alias("fingerprint"))


@P.add("SELECT event_type, count(*) AS n_rows, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS sum_k, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS n_missing FROM events GROUP BY 1")
def props_validate(t):
    """Properties held against their contract: k is a number."""
    k = F.get_json_object("props", "$.k")
    return t("events").groupBy("event_type").agg(F.count("*").alias("n_rows"), F.sum(k.cast("long")).alias("sum_k"), F.sum(k.isNull().cast("long")).alias("n_missing"))


@P.add(r"SELECT page_id, len(regexp_extract_all(html, '(?i)<p[ >]')) AS n_paragraphs, length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) AS text_chars FROM pages")
def html_lines(t):
    """Paragraphs of pages and the characters outside of tags."""
    return t("pages").select("page_id", F.regexp_count("html", F.lit("(?i)<p[ >]")).alias("n_paragraphs"), F.length(F.trim(F.regexp_replace("html", "<[^>]*>", ""))).alias("text_chars"))
