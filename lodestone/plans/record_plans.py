"""Registries, links and ordered operators over the star schema, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking as L
from ..operators import ordered as O
from ..operators import registry as R
from .base import Plans

P = Plans()


@P.add("""SELECT md5(text) AS text_key, min(doc_id) OVER w AS doc_id, doc_id AS lineage, count(*) OVER w AS n_copies FROM documents WINDOW w AS (PARTITION BY md5(text))""")
def dedupe_first_lineage(t):
    """Each document with the first of those equal to it."""
    d = t("documents").select("doc_id", F.md5("text").alias("text_key"))
    return R.first_by_key(d, ["text_key"], "doc_id", "lineage")


@P.add("SELECT md5(text) AS key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(t):
    return R.duplicate_keys(t("documents"), F.md5("text"))


@P.add("SELECT lower(trim(p_name)) AS name_key, min(p_partkey) AS p_partkey FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1")
def concept_lookup_ambiguous(t):
    """Names that one part alone owns."""
    return R.unambiguous_lookup(t("part").select("p_partkey", R.name_key(F.col("p_name")).alias("name_key")), "name_key", "p_partkey")


@P.add("""WITH lookup AS (SELECT lower(trim(p_name)) AS k, p_brand AS b, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) = 1),
 named AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE p_brand || ' ' || lower(trim(p_name)) END AS term FROM lineitem JOIN part ON l_partkey = part.p_partkey)
 SELECT CASE WHEN term IS NULL THEN 'not_applicable' WHEN lookup.p_partkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, l_linenumber, count(*) AS n, count(DISTINCT lookup.p_partkey) AS n_targets
 FROM named LEFT JOIN lookup ON term = b || ' ' || k GROUP BY 1, 2""")
def reference_resolve(t):
    """Terms of order lines resolved against unambiguous names."""
    p = t("part").select("p_partkey", F.concat("p_brand", F.lit(" "), R.name_key(F.col("p_name"))).alias("name_key"))
    lookup = R.unambiguous_lookup(p, "name_key", "p_partkey")
    rows = t("lineitem").join(p.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 7 != 0, F.col("name_key")).alias("term"))
    return R.resolve(rows, F.col("term"), lookup, "name_key", "p_partkey").groupBy("status", "l_linenumber").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("n_targets"))


@P.add("""SELECT DISTINCT s_nationkey AS nation, 'supplier' AS kind, s_suppkey AS source FROM supplier UNION ALL SELECT DISTINCT c_nationkey, 'customer', c_custkey FROM customer""")
def reverse_links(t):
    s = t("supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("source"))
    c = t("customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"), F.col("c_custkey").alias("source"))
    return R.reverse_links(s.unionByName(c), "nation", "kind", "source")


_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey"}


@P.add(" UNION ALL ".join(f"SELECT '{n}' AS registry, count(*) AS n_rows, count(DISTINCT {k}) AS n_ids FROM {n}" for n, k in _KEYS.items()))
def registry_union_counts(t):
    return R.union_counts({n: t(n) for n in _KEYS}, _KEYS)


@P.add("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey, n_name || '_NEW', n_regionkey FROM nation WHERE n_regionkey = 2")
def registry_upsert(t):
    n = t("nation")
    return R.upsert(n, n.where("n_regionkey = 2").withColumn("n_name", F.concat("n_name", F.lit("_NEW"))), "n_nationkey")


@P.add("""SELECT event_id, max(p_partkey) AS p_partkey, count(*) AS n_spans FROM events JOIN part ON p_size * 10.0 <= value AND value <= p_size * 10.0 + 5 GROUP BY event_id""")
def range_link(t):
    """Events in the value spans of parts; the last part in order wins."""
    spans = t("part").select("p_partkey", (F.col("p_size") * 10.0).alias("lo"), (F.col("p_size") * 10.0 + 5).alias("hi"))
    return L.range_tally(t("events").select("event_id", "value"), "event_id", "value", spans, "p_partkey", "lo", "hi", 5.0)


@P.add("""SELECT a.conv_id, a.turn, count(*) AS n_near, sum(length(b.text)) AS near_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 AND a.turn <> b.turn GROUP BY 1, 2""")
def band_neighbours(t):
    """Turns within two of a turn."""
    c = t("conversations")
    near = L.band_neighbours(c.select("conv_id", "turn", F.col("turn").alias("item")), "conv_id", "turn", "item", 2)
    size = c.select("conv_id", F.col("turn").alias("near"), F.length("text").alias("chars"))
    return near.join(size, ["conv_id", "near"]).groupBy("conv_id", "turn").agg(F.count("*").alias("n_near"), F.sum("chars").alias("near_chars"))


@P.add("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS at, event_type FROM events),
 p AS (SELECT a.event_id, b.event_id AS view_id, abs(a.at - b.at) AS distance FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND abs(a.at - b.at) <= 86400000000)
 SELECT event_id, arg_min(view_id, {'d': distance, 'v': view_id}) AS view_id, min(distance) AS distance FROM p GROUP BY 1""")
def nearest_match(t):
    """The view of the same user nearest in time to each purchase, within a day."""
    e = t("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp_ltz")).alias("at"), "event_type")
    rows = e.where("event_type = 'purchase'").select("user_id", "event_id", "at")
    views = e.where("event_type = 'view'").select("user_id", F.col("at").alias("view_at"), F.col("event_id").alias("view_id"))
    return L.nearest(rows, views, "user_id", "at", "view_at", "view_id", 86_400_000_000).select("event_id", "view_id", "distance")


@P.add("""SELECT a.event_id, max_by(b.event_id, b.ts) AS previous FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' AND b.ts < a.ts WHERE a.event_type = 'purchase' GROUP BY 1""")
def asof_previous(t):
    """The last view strictly before each purchase of a user."""
    e = t("events")
    facts = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("view_id"))
    return L.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), facts, "user_id", "ts", "since", "view_id").select("event_id", "previous")


@P.add("SELECT * FROM (SELECT conv_id, turn AS source, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations) WHERE target IS NOT NULL")
def precedes_edges(t):
    return O.precedes(t("conversations"), "conv_id", "turn", "turn")


@P.add("SELECT n_regionkey, n_name, lag(n_name) OVER w AS previous, lead(n_name) OVER w AS next, row_number() OVER w AS ordinal FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
def sibling_links(t):
    return O.siblings(t("nation"), "n_regionkey", "n_nationkey", "n_name")


@P.add("""WITH g AS (SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) > 7200000000 AS INT), 0) AS b FROM events),
 c AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS cluster FROM g)
 SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n_events, round(sum(value), 2) AS total FROM c GROUP BY 1, 2""")
def gap_clusters(t):
    """Sessions: a gap of over two hours begins a new one."""
    e = t("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp_ltz")))
    return O.gap_clusters(e, "user_id", "at", 7_200_000_000).groupBy("user_id", "cluster").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total"))


@P.add("""SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, CASE WHEN step = 0 THEN 'duplicate' ELSE 'skipped' END AS break_kind FROM (SELECT l_orderkey, l_linenumber, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS step FROM lineitem) WHERE step = 0 OR step > 1""")
def sequence_check(t):
    return O.sequence_breaks(t("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@P.add("""SELECT c AS o_custkey, k AS o_orderkey, CAST(nth AS INT) AS nth FROM (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER w AS nth, sum(CAST(round(o_totalprice) AS BIGINT)) OVER w AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE running <= 500000 OR nth = 1""")
def time_budget_path(t):
    """Orders of a customer in time order within a budget, the first always."""
    o = t("orders").withColumn("cost", F.round("o_totalprice").cast("long"))
    return O.within_budget(o, "o_custkey", ["o_orderdate", "o_orderkey"], "cost", 500_000).select("o_custkey", "o_orderkey", "nth")


@P.add("""WITH m AS (SELECT *, sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations),
 n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn) AS nth FROM m WHERE block > 0)
 SELECT conv_id, CAST(block AS BIGINT) AS block, min(turn) AS label_at, count(*) - 1 AS n_body, CAST(sum(CASE WHEN nth > 1 THEN length(text) END) AS BIGINT) AS body_chars FROM n WHERE nth <= 13 GROUP BY 1, 2""")
def label_body(t):
    """Each user turn with up to 12 turns after it, up to the next user turn."""
    return O.until_next_label(t("conversations"), "conv_id", "turn", F.col("role") == "user", "text", 12)


@P.add("SELECT event_id, user_id, event_type FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY ts DESC, event_id LIMIT 20")
def recent_activity(t):
    """The newest 20 events of a user."""
    e = t("events")
    first = e.agg(F.min("user_id").alias("user_id"))
    return e.join(F.broadcast(first), "user_id").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "user_id", "event_type")


@P.add("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '1') AND c_mktsegment = 'FURNITURE' ORDER BY c_acctbal NULLS LAST, c_custkey LIMIT 25 OFFSET 25")
def filtered_page(t):
    """The second page of 25 of a filtered and sorted table."""
    c = t("customer").where(F.contains(F.lower("c_name"), F.lit("1")) & (F.col("c_mktsegment") == "FURNITURE"))
    return c.orderBy(F.col("c_acctbal").asc_nulls_last(), "c_custkey").offset(25).limit(25).select("c_custkey", "c_name")
