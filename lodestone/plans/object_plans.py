"""Enrichment, boxes, headings, trees and reports over the star schema and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..sources import lines as L
from .base import Plans

P = Plans()


@P.add("""SELECT p_partkey, trim(p_name) AS display_name, lower(trim(p_name)) AS normalized_name, CASE p_type WHEN 'ECONOMY' THEN 'core' WHEN 'STANDARD' THEN 'core' ELSE 'supporting' END AS role,
 CASE WHEN p_size / 50.0 >= 0.75 THEN 'high' WHEN p_size / 50.0 >= 0.4 THEN 'medium' ELSE 'low' END AS importance, p_name || ' - ' || p_brand AS summary FROM part""")
def enrich_objects(t):
    """Derived columns of registry items: names, role, importance and summary."""
    role = F.create_map(*[F.lit(x) for kv in {"ECONOMY": "core", "STANDARD": "core"}.items() for x in kv])
    return t("part").select("p_partkey", F.trim("p_name").alias("display_name"), F.lower(F.trim("p_name")).alias("normalized_name"), F.coalesce(role[F.col("p_type")], F.lit("supporting")).alias("role"), X.confidence_band(F.col("p_size") / 50.0).alias("importance"), F.concat_ws(" - ", "p_name", "p_brand").alias("summary"))


_BOX = "SELECT l_orderkey AS page, l_linenumber AS n, l_quantity AS x0, l_quantity + 20 AS x1, l_tax * 100 AS y0, l_tax * 100 + 20 AS y1 FROM lineitem"


def boxes(t, side):
    p = f"{side}_"
    q, y = F.col("l_quantity"), F.col("l_tax") * 100
    return t("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias(p + "n"), q.alias(p + "x0"), (q + 20).alias(p + "x1"), y.alias(p + "y0"), (y + 20).alias(p + "y1"))


@P.add(f"""WITH b AS ({_BOX}), p AS (SELECT a.page, a.n AS kept, b.n AS dropped, greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i FROM b a JOIN b ON a.page = b.page AND a.n < b.n)
 SELECT page, kept, dropped, round(i / (800 - i), 4) AS iou FROM p WHERE round(i / (800 - i), 6) >= 0.5""")
def spatial_duplicates(t):
    """Pairs of boxes of one page that overlap by half or more; what stays when the first of each pair drops the other is in ``kept_boxes``."""
    pairs = boxes(t, "a").join(boxes(t, "b"), "page").where("a_n < b_n").withColumn("iou", X.iou("a", "b")).where("round(iou, 6) >= 0.5")
    return pairs.select("page", F.col("a_n").alias("kept"), F.col("b_n").alias("dropped"), F.round("iou", 4).alias("iou"))


@P.add(f"""WITH b AS ({_BOX}) SELECT a.page, a.n AS outside, b.n AS inside FROM b a JOIN b ON a.page = b.page AND a.n <> b.n AND b.x0 >= a.x0 - 5 AND b.x1 <= a.x1 + 5 AND round(b.y0 - a.y0, 6) >= -5 AND round(b.y1 - a.y1, 6) <= 5""")
def contained_boxes(t):
    """Boxes inside others, with five points of tolerance."""
    pairs = boxes(t, "a").join(boxes(t, "b"), "page").where("a_n <> b_n and b_x0 >= a_x0 - 5 and b_x1 <= a_x1 + 5 and round(b_y0 - a_y0, 6) >= -5 and round(b_y1 - a_y1, 6) <= 5")
    return pairs.select("page", F.col("a_n").alias("outside"), F.col("b_n").alias("inside"))


@P.add("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'hierarchical' WHEN 1 THEN 'numbered' WHEN 2 THEN 'chapter' WHEN 3 THEN 'alphabetic' ELSE 'none' END AS kind,
 CASE o_orderkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 3 END AS level FROM orders""")
def heading_kinds(t):
    """Headings recognised by the shape of their number."""
    key = F.col("o_orderkey")
    s = F.when(key % 5 == 0, F.concat(F.lit("1.2."), key)).when(key % 5 == 1, F.concat(key % 90 + 1, F.lit("."))).when(key % 5 == 2, F.concat(F.lit("Chapter "), key)).when(key % 5 == 3, F.lit("(b)")).otherwise(F.lit("plain words"))
    kind = F.when(s.rlike(r"^[0-9]+(\.[0-9]+)+$"), "hierarchical").when(s.rlike(r"^[0-9]{1,4}\.?$"), "numbered").when(s.rlike(r"(?i)^chapter ([0-9]+|[ivxlc]+)$"), "chapter").when(s.rlike(r"^\(?[A-Za-z]\)?$"), "alphabetic").otherwise("none")
    level = F.when(F.col("kind") == "hierarchical", F.least(F.lit(6), F.size(F.split("s", r"\.")))).when(F.col("kind").isin("numbered", "chapter"), 1).when(F.col("kind") == "alphabetic", 3)
    return t("orders").select("o_orderkey", s.alias("s"), kind.alias("kind")).select("o_orderkey", "kind", level.alias("level"))


def structural(lines):
    score = 0.35 * F.least(F.lit(1.0), F.col("l_quantity") / 50) + 0.35 * (1 - F.col("l_discount")) + 0.20 * (1 - F.col("l_tax")) + F.when(F.col("l_linestatus") == "O", 0.10).otherwise(0.0)
    return lines.select("l_orderkey", "l_linenumber", F.round(score, 4).alias("structural"))


@P.add("""SELECT l_orderkey, l_linenumber, round(0.35 * least(1, l_quantity / 50) + 0.35 * (1 - l_discount) + 0.20 * (1 - l_tax) + CASE WHEN l_linestatus = 'O' THEN 0.10 ELSE 0 END, 4) AS structural FROM lineitem""")
def structural_confidence(t):
    """Weighted evidence .35/.35/.20/.10."""
    return structural(t("lineitem"))


@P.add("""SELECT o_orderpriority, o_orderstatus, count(*) AS n_items, array_to_string(list_sort(list(o_orderkey))[:5], ',') AS first_items FROM orders GROUP BY 1, 2""")
def question_navigation(t):
    """Items by difficulty and type, with a test of the first five of each: ranks within salts first."""
    from pyspark.sql import Window

    o = t("orders").select("o_orderpriority", "o_orderstatus", "o_orderkey", F.pmod(F.xxhash64("o_orderkey"), F.lit(32)).alias("salt"))
    few = o.withColumn("nth", F.row_number().over(Window.partitionBy("o_orderpriority", "o_orderstatus", "salt").orderBy("o_orderkey"))).where("nth <= 5")
    first = few.groupBy("o_orderpriority", "o_orderstatus").agg(F.array_join(F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 5).cast("array<string>"), ",").alias("first_items"))
    return o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n_items")).join(first, ["o_orderpriority", "o_orderstatus"])


@P.add("""WITH n AS (SELECT 'n' || n_nationkey AS node, CASE WHEN n_nationkey % 11 = 5 THEN 'missing' ELSE 'r' || n_regionkey END AS parent, CASE WHEN n_nationkey % 13 = 3 THEN 3 ELSE 2 END AS level FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world', 1 FROM region UNION ALL SELECT 'world', NULL, 0)
 SELECT 'S1' AS rule, node, parent AS detail FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM n) UNION ALL SELECT 'S2', 'tree', CAST(count(*) AS VARCHAR) FROM n WHERE parent IS NULL HAVING count(*) <> 1
 UNION ALL SELECT 'B1', c.node, CAST(c.level AS VARCHAR) FROM n c JOIN n p ON c.parent = p.node WHERE c.level <> p.level + 1""")
def tree_invariants(t):
    """Dangling parents, the number of roots, and levels that do not follow the parent's."""
    spark = t("nation").sparkSession
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.when(F.col("n_nationkey") % 11 == 5, "missing").otherwise(F.concat(F.lit("r"), "n_regionkey")).alias("parent"), F.when(F.col("n_nationkey") % 13 == 3, 3).otherwise(2).alias("level"))
    n = n.union(t("region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("world"), F.lit(1))).union(spark.createDataFrame([("world", None, 0)], "node string, parent string, level int"))
    p = n.select(F.col("node").alias("parent"), F.col("level").alias("above"))
    s1 = n.where("parent is not null").join(p, "parent", "left_anti").select(F.lit("S1").alias("rule"), "node", F.col("parent").alias("detail"))
    s2 = n.where("parent is null").agg(F.count("*").alias("n")).where("n <> 1").select(F.lit("S2").alias("rule"), F.lit("tree").alias("node"), F.col("n").cast("string").alias("detail"))
    b1 = n.join(p, "parent").where("level <> above + 1").select(F.lit("B1").alias("rule"), "node", F.col("level").cast("string").alias("detail"))
    return s1.unionByName(s2).unionByName(b1)


@P.add("""WITH a AS (SELECT p_brand, p_partkey // 4096 AS k, sha256(string_agg(CAST(p_partkey AS VARCHAR) || '|' || p_name, ';' ORDER BY p_partkey)) AS s FROM part GROUP BY 1, 2),
 b AS (SELECT p_brand, k // 4096 AS k, sha256(string_agg(s, ';' ORDER BY k)) AS s FROM a GROUP BY p_brand, k // 4096) SELECT p_brand, sha256(string_agg(s, ';' ORDER BY k)) AS fingerprint FROM b GROUP BY 1""")
def registry_fingerprints(t):
    """One sha256 for the ordered rows of each registry, over blocks of keys."""
    return A.block_fingerprints(t("part"), "p_brand", "p_partkey", F.concat_ws("|", "p_partkey", "p_name"))


@P.add("""WITH e AS (SELECT DISTINCT l_suppkey AS a, l_suppkey % 7 AS b FROM lineitem WHERE l_suppkey <> l_suppkey % 7), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT a AS node, b AS related FROM s""")
def related_backfill(t):
    """Symmetric closure of related links, a row for each."""
    e = t("lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") % 7).alias("b")).where("a <> b").distinct()
    return e.union(e.select("b", "a")).distinct().toDF("node", "related")


@P.add("""SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a_links, count(*) FILTER (WHERE l_returnflag = 'N') AS n_links, count(*) FILTER (WHERE l_returnflag = 'R') AS r_links FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem) GROUP BY 1""")
def cross_references_pivot(t):
    """Neighbours bucketed by category."""
    d = t("lineitem").select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    return d.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"A": "a_links", "N": "n_links", "R": "r_links"})


@P.add("SELECT lang, line, n FROM (SELECT lang, line, count(DISTINCT doc_id) AS n FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) > 0 GROUP BY 1, 2) JOIN (SELECT lang AS g, count(DISTINCT doc_id) // 50 AS k FROM documents WHERE length(trim(text)) > 0 GROUP BY 1) ON g = lang WHERE n >= greatest(3, k)")
def repeated_lines(t):
    """Lines that stand in many documents of a language."""
    d = t("documents")
    n = L.text_lines(d.select("doc_id", "text"), "doc_id", "text").join(d.select("doc_id", "lang"), "doc_id").groupBy("lang", "line").agg(F.count_distinct("doc_id").alias("n"))
    k = d.where(F.length(F.trim("text")) > 0).groupBy("lang").agg(F.floor(F.count_distinct("doc_id") / 50).alias("k"))
    return n.join(k, "lang").where(F.col("n") >= F.greatest(F.lit(3), F.col("k"))).select("lang", "line", "n")


@P.add("SELECT conv_id, count(*) AS n_turns, sum(length(text)) AS n_chars, count(*) FILTER (WHERE role = 'user') AS n_user, max(turn) AS last_turn FROM conversations GROUP BY 1")
def content_counts(t):
    """Counts of a section's parts."""
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"), F.count_if(F.col("role") == "user").alias("n_user"), F.max("turn").alias("last_turn"))


@P.add("""SELECT o_custkey, CASE WHEN n = 0 THEN 'NO_BASELINE' WHEN late > 0 THEN 'DIVERGENT' ELSE 'CONSISTENT' END AS verdict FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS late FROM orders GROUP BY 1)""")
def reuse_verdict(t):
    """Whether what was reused agrees with its baseline."""
    c = t("orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"), F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("late"))
    return c.select("o_custkey", F.when(F.col("n") == 0, "NO_BASELINE").when(F.col("late") > 0, "DIVERGENT").otherwise("CONSISTENT").alias("verdict"))


@P.add("""SELECT user_id, event_type, n_total, minutes FROM (SELECT user_id, event_type, count(*) AS n_total, count(*) * CASE event_type WHEN 'purchase' THEN 3 ELSE 2 END AS minutes FROM events GROUP BY 1, 2) WHERE n_total >= 3""")
def assessment_minutes(t):
    """Sets of items with their minutes."""
    n = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n_total")).where("n_total >= 3")
    return n.withColumn("minutes", F.col("n_total") * F.when(F.col("event_type") == "purchase", 3).otherwise(2))


def staged(lines):
    q = F.col("l_quantity")
    return lines.select("l_orderkey", "l_linenumber", *[F.round(share * q / 100, 2).alias(f"s{i}") for i, share in ((1, 15), (2, 25), (3, 30))])


@P.add("SELECT l_orderkey, l_linenumber, round(15 * l_quantity / 100, 2) AS s1, round(25 * l_quantity / 100, 2) AS s2, round(30 * l_quantity / 100, 2) AS s3 FROM lineitem")
def stage_minutes(t):
    """Minutes split over stages."""
    return staged(t("lineitem"))
