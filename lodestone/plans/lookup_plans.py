"""Runtime lookups: concepts are suppliers, sections nations, their resources the parts of their order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as L
from .base import Plans, quoted_list

P = Plans()
KINDS = ("example", "worked_example", "figure", "table", "formula", "analogy", "activity", "mistake", "misconception", "application", "related", "question", "assessment", "note")
_RES = f"(SELECT l_suppkey AS concept_id, list_extract({quoted_list(KINDS)}, CAST(l_partkey % {len(KINDS)} + 1 AS INT)) AS kind, min(l_orderkey) AS ord, l_partkey AS item_id, min(l_quantity) AS minutes FROM lineitem GROUP BY 1, 2, 4)"


def resources(t):
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("l_partkey") % len(KINDS) + 1).cast("int"))
    rows = t("lineitem").groupBy(F.col("l_suppkey").alias("concept_id"), F.col("l_partkey").alias("item_id")).agg(F.min("l_orderkey").alias("ord"), F.min("l_quantity").alias("minutes"))
    return rows.withColumn("l_partkey", F.col("item_id")).withColumn("kind", kind).drop("l_partkey")


def concepts(t):
    return t("supplier").select(F.col("s_suppkey").alias("concept_id"), "s_name", "s_nationkey", "s_acctbal")


@P.add("SELECT s_suppkey AS concept_id, s_name, s_acctbal FROM supplier WHERE s_suppkey = 7")
def concept_by_id(t):
    """One concept by its id: a filter at the scan."""
    return concepts(t).where("concept_id = 7").select("concept_id", "s_name", "s_acctbal")


@P.add("SELECT c.c_custkey, s.s_suppkey AS concept_id FROM customer c JOIN supplier s ON lower('SUPPLIER#' || right(c.c_name, 9)) = lower(s.s_name)")
def concepts_by_name(t):
    """Concepts for many names, whatever their case."""
    asked = t("customer").select("c_custkey", F.lower(F.concat(F.lit("SUPPLIER#"), F.expr("right(c_name, 9)"))).alias("name"))
    return asked.join(concepts(t).withColumn("name", F.lower("s_name")), "name").select("c_custkey", "concept_id")


@P.add("SELECT regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '_', 'g') AS concept_key, min(s_suppkey) AS concept_id, count(*) AS n FROM supplier GROUP BY 1")
def concepts_by_key(t):
    """Canonical keys with their concept."""
    key = F.regexp_replace(F.lower(F.trim("s_name")), "[^a-z0-9]+", "_")
    return concepts(t).groupBy(key.alias("concept_key")).agg(F.min("concept_id").alias("concept_id"), F.count("*").alias("n"))


@P.add("SELECT n_nationkey, s_suppkey AS concept_id, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS nth FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def units_of_sections(t):
    """The units of each section in order; sections without units give none."""
    rows = t("nation").select("n_nationkey").join(concepts(t), F.col("n_nationkey") == F.col("s_nationkey")).withColumn("least", -F.col("s_acctbal"))
    return L.first_distinct(rows, "n_nationkey", "concept_id", ["least", "concept_id"]).select("n_nationkey", "concept_id", "nth")


def _items(kinds):
    place = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(kinds))
    return f"SELECT concept_id, kind, item_id, CAST(row_number() OVER (PARTITION BY concept_id ORDER BY CASE kind {place} END, ord, item_id) AS INT) AS nth FROM {_RES} WHERE kind IN ({', '.join(repr(k) for k in kinds)})"


def some_items(t, *kinds):
    return L.items(resources(t), concepts(t), kinds).select("concept_id", "kind", "item_id", "nth")


@P.add(_items(("example", "worked_example")))
def examples_of_concepts(t):
    """Examples, then worked ones."""
    return some_items(t, "example", "worked_example")


@P.add(_items(("worked_example",)))
def worked_examples_of_concepts(t):
    return some_items(t, "worked_example")


@P.add(" UNION ALL ".join(_items((k,)) for k in ("table", "formula", "analogy", "activity", "mistake", "misconception", "application", "related", "question")))
def nested_resources(t):
    """Tables, formulae, analogies, activities, mistakes, misconceptions, applications, related concepts and practice questions, each kind in its order."""
    kinds = ("table", "formula", "analogy", "activity", "mistake", "misconception", "application", "related", "question")
    rows = resources(t).where(F.col("kind").isin(*kinds)).join(concepts(t).select("concept_id"), "concept_id")
    w = F.row_number().over(L.Window.partitionBy("concept_id", "kind").orderBy("ord", "item_id"))
    return rows.select("concept_id", "kind", "item_id", w.alias("nth"))


@P.add(f"""SELECT s_nationkey, item_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY concept_id, ord, item_id) AS INT) AS nth FROM (
 SELECT s_nationkey, concept_id, ord, item_id, row_number() OVER (PARTITION BY s_nationkey, item_id ORDER BY concept_id, ord, item_id) AS seen FROM {_RES} JOIN supplier ON s_suppkey = concept_id WHERE kind = 'figure') WHERE seen = 1""")
def figures_of_sections(t):
    """Figures of a section's concepts, each once, where it comes first."""
    rows = resources(t).where("kind = 'figure'").join(concepts(t).select("concept_id", "s_nationkey"), "concept_id")
    return L.first_distinct(rows, "s_nationkey", "item_id", ["concept_id", "ord", "item_id"]).select("s_nationkey", "item_id", "nth")


@P.add(f"SELECT concept_id, count(*) AS n_items, array_to_string(list(item_id ORDER BY ord, item_id)[1:5], ',') AS first_items FROM {_RES} WHERE kind = 'assessment' AND concept_id IN (SELECT o_custkey FROM orders) GROUP BY 1")
def assessments_batch(t):
    """Assessment items of the concepts that a list of ids asks for: their number and the first five."""
    asked = L.items(resources(t), t("orders").select(F.col("o_custkey").alias("concept_id")), ["assessment"])
    few = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= 5, F.struct("nth", "item_id")))), lambda r: r["item_id"].cast("string")), ",")
    return asked.groupBy("concept_id").agg(F.count("*").alias("n_items"), few.alias("first_items"))


@P.add(f"SELECT concept_id, arg_min(item_id, {{'m': minutes, 'i': item_id}}) AS item_id, min(minutes) AS minutes FROM {_RES} WHERE kind IN ('mistake', 'misconception') GROUP BY 1")
def remediation_path(t):
    """The quickest remedy of each concept, the smaller id of equal ones."""
    rows = resources(t).where("kind in ('mistake', 'misconception')").select("concept_id", "item_id", "minutes")
    return L.best_by(rows, "concept_id", ["minutes", "item_id"])


@P.add("SELECT s_suppkey AS concept_id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS position FROM supplier")
def learning_path(t):
    """All concepts in the order of a style, with their positions."""
    rows = concepts(t).select("concept_id", (-F.col("s_acctbal")).alias("least"))
    return L.in_order(rows, ["least", "concept_id"]).select("concept_id", F.col("position").cast("long").alias("position"))


@P.add("SELECT s_nationkey AS goal, arg_min(s_suppkey, {'a': s_acctbal, 's': s_suppkey}) AS concept_id FROM supplier GROUP BY 1")
def learning_path_to(t):
    """The first chain whose root is the goal."""
    return L.best_by(concepts(t).select(F.col("s_nationkey").alias("goal"), "concept_id", "s_acctbal"), "goal", ["s_acctbal", "concept_id"]).select("goal", "concept_id")


@P.add(f"""SELECT item_id, concept_id FROM (SELECT item_id, concept_id, row_number() OVER (PARTITION BY item_id ORDER BY s_acctbal DESC, concept_id, ord) AS seen FROM {_RES} JOIN supplier ON s_suppkey = concept_id WHERE kind = 'note') WHERE seen = 1""")
def revision_notes(t):
    """All notes, each once, at the first concept of the order that has it."""
    rows = resources(t).where("kind = 'note'").join(concepts(t), "concept_id").select("item_id", "concept_id", (-F.col("s_acctbal")).alias("least"), "ord")
    return L.best_by(rows, "item_id", ["least", "concept_id", "ord"]).select("item_id", "concept_id")


@P.add("SELECT o_orderpriority AS difficulty, o_orderkey AS item_id, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS nth FROM orders) WHERE nth <= 5")
def chapter_test(t):
    """The first five items of each difficulty: five of each salt first."""
    w = lambda *k: L.Window.partitionBy("difficulty", *k).orderBy("item_id")
    rows = t("orders").select(F.col("o_orderpriority").alias("difficulty"), F.col("o_orderkey").alias("item_id")).withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(64)))
    few = rows.withColumn("nth", F.row_number().over(w("salt"))).where("nth <= 5")
    return few.withColumn("nth", F.row_number().over(w())).where("nth <= 5").select("difficulty", "item_id", "nth")


@P.add("SELECT o_orderkey AS item_id, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS INT) AS nth FROM (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderpriority, o_orderkey LIMIT 5)")
def quick_check(t):
    """The first five of the easy items, then of the medium ones."""
    few = t("orders").where("o_orderpriority in ('1-URGENT', '2-HIGH')").select("o_orderpriority", F.col("o_orderkey").alias("item_id")).orderBy("o_orderpriority", "item_id").limit(5)
    return few.select("item_id", F.row_number().over(L.Window.orderBy("o_orderpriority", "item_id")).alias("nth"))  # five rows


@P.add("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN round(o_totalprice * 15 / 100 + 1e-6, 2) WHEN 'O' THEN round(o_totalprice * 25 / 100 + 1e-6, 2) END AS minutes, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS revised FROM orders""")
def stage_resources(t):
    """The template's value for the stage of each row, null for an unknown stage."""
    price = F.col("o_totalprice")
    value = L.field_of_stage({"F": F.round(price * 15 / 100 + 1e-6, 2), "O": F.round(price * 25 / 100 + 1e-6, 2)}, F.col("o_orderstatus"))
    return t("orders").select("o_orderkey", value.alias("minutes"), L.field_of_stage({"F": F.col("o_orderdate")}, F.col("o_orderstatus")).alias("revised"))


@P.add("""SELECT tier, count(*) AS n_units, round(sum(c_acctbal), 2) AS minutes, CASE tier WHEN 'core' THEN 1 WHEN 'supporting' THEN 3 ELSE 7 END AS interval_days FROM (
 SELECT c_acctbal, CASE WHEN c_acctbal >= 7000 THEN 'core' WHEN c_acctbal >= 3000 THEN 'supporting' ELSE 'enrichment' END AS tier FROM customer) GROUP BY 1""")
def spaced_repetition_groups(t):
    """Units by tier, with their minutes and the days between repetitions."""
    tier = F.when(F.col("c_acctbal") >= 7000, "core").when(F.col("c_acctbal") >= 3000, "supporting").otherwise("enrichment")
    n = t("customer").groupBy(tier.alias("tier")).agg(F.count("*").alias("n_units"), F.round(F.sum("c_acctbal"), 2).alias("minutes"))
    return n.withColumn("interval_days", F.when(F.col("tier") == "core", 1).when(F.col("tier") == "supporting", 3).otherwise(7))


@P.add("""SELECT key, version, NOT compatible AS is_fallback FROM (SELECT key, version, compatible, row_number() OVER (PARTITION BY key ORDER BY compatible DESC, a DESC, b DESC) AS nth FROM (
 SELECT l_partkey AS key, l_linenumber || '.' || l_suppkey AS version, l_linenumber AS a, l_suppkey AS b, l_returnflag <> 'R' AND l_linenumber <= 4 AS compatible FROM lineitem)) WHERE nth = 1""")
def newest_versions(t):
    """The newest compatible version of each pattern that is not withdrawn, else the newest of all."""
    ok = (F.col("l_returnflag") != "R") & (F.col("l_linenumber") <= 4)
    rows = t("lineitem").select(F.col("l_partkey").alias("key"), F.concat_ws(".", "l_linenumber", "l_suppkey").alias("version"), (~ok).alias("is_fallback"), (-F.col("l_linenumber")).alias("a"), (-F.col("l_suppkey")).alias("b"))
    return L.best_by(rows, "key", ["is_fallback", "a", "b"]).select("key", "version", "is_fallback")


@P.add(f"SELECT count(*) AS n_items, count(DISTINCT concept_id) AS n_concepts, count(*) FILTER (WHERE kind = 'figure') AS n_figures, count(*) FILTER (WHERE kind = 'assessment') AS n_assessments, round(sum(minutes), 2) AS minutes FROM {_RES}")
def knowledge_base_info(t):
    """One row of counts."""
    r = resources(t)
    return r.agg(F.count("*").alias("n_items"), F.count_distinct("concept_id").alias("n_concepts"), F.count_if(F.col("kind") == "figure").alias("n_figures"), F.count_if(F.col("kind") == "assessment").alias("n_assessments"), F.round(F.sum("minutes"), 2).alias("minutes"))


@P.add(f"""SELECT concept_id, kind, item_id, substr(coalesce(p_name, ''), 1, 6) AS text FROM {_RES} LEFT JOIN part ON item_id = p_partkey WHERE kind IN ('example', 'formula', 'activity', 'figure')
 UNION ALL SELECT s_suppkey, 'concept', s_suppkey, substr(s_name, 1, 12) FROM supplier""")
def search_documents(t):
    """Search documents of six kinds with capped texts."""
    r = resources(t).where("kind in ('example', 'formula', 'activity', 'figure')").join(t("part").select(F.col("p_partkey").alias("item_id"), "p_name"), "item_id", "left")
    docs = r.select("concept_id", "kind", "item_id", F.substring(F.coalesce("p_name", F.lit("")), 1, 6).alias("text"))
    return docs.unionByName(concepts(t).select("concept_id", F.lit("concept").alias("kind"), F.col("concept_id").alias("item_id"), F.substring("s_name", 1, 12).alias("text")))


@P.add(f"SELECT concept_id, list_sort(list(item_id ORDER BY item_id))[1] AS first_item, count(*) AS n_items, round(avg(minutes), 4) AS mean_minutes FROM {_RES} WHERE kind = 'assessment' AND minutes BETWEEN 5 AND 40 GROUP BY 1 HAVING count(*) >= 1")
def diagnostic_items(t):
    """Assessment items of each concept within bounds of their minutes."""
    r = resources(t).where("kind = 'assessment' and minutes between 5 and 40")
    return r.groupBy("concept_id").agg(F.min("item_id").alias("first_item"), F.count("*").alias("n_items"), F.round(F.avg("minutes"), 4).alias("mean_minutes"))
