"""Mixing sources to target weights by Efraimidis-Spirakis sampling [DataFrame functions only].

A source's target is its weighted share of the whole budget, held to ``max_epochs`` times its size; what is cut off is
shared out again by weight. Whole epochs come first; the rest of the target is filled in the order of the keys
``-ln(u) / quality`` (a draw without replacement with odds by quality), up to the document whose middle lies at the budget.

Only sums by source and by slice of the key cross the cluster: a source's cut in the key order is found from the prefix
sums of slices (more of them where there are more rows) and from the inside of one slice, and sources are ranked and filled
in ranges, so that neither a source with a third of all rows nor very many sources need a single task.

Nulls and edges: a null text has no words and takes nothing; a null source is a source, the last in order; a null doc_id
draws by its text alone. Rows that repeat a doc_id with other texts draw keys of their own; rows equal in doc_id and text
draw one key, and as many of them are taken as the target needs; an empty table gives an empty table; other columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Signs that prose seldom has; their share lowers a document's quality weight.
SIGNS = "#$%&*+<=>@[]^_{|}~"
#: Cuts for up to so many sources are broadcast (some 60 bytes each); more are joined by shuffling.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prose_weight(text: Column) -> Column:
    """0.25 to 1: the share of characters that are not in ``SIGNS``, on that scale; 1 for an empty text."""
    whole = F.length(text)
    return F.when(whole > 0, 0.25 + 0.75 * F.length(F.translate(text, SIGNS, "")) / whole).otherwise(F.lit(1.0))


def draw_key(doc_id: Column, text: Column, quality: Column, seed: int) -> Column:
    """The exponential key. ``u`` comes from 52 bits of an md5 of id and text, so that reruns and other engines agree."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit(""))))
    return -F.log((F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)) / quality


def running(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with running sums (this row included) over a total order: within ranges of it, then over the ranges' totals."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    held = materialise(placed, name)
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = held.select("*", *[F.sum(c).over(inside).alias(f"in_{n}") for n, c in sums.items()])
    totals = held.groupBy("range").agg(*[F.max(f"in_{n}").alias(f"all_{n}") for n in sums])  # a row for each shuffle partition
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("range", *[F.coalesce(F.sum(f"all_{n}").over(earlier), F.lit(0)).alias(f"before_{n}") for n in sums])
    return held.join(before, "range").select(*rows.columns, *[(F.col(f"in_{n}") + F.col(f"before_{n}")).alias(n) for n in sums])


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``. A source is held to its limit when filling all to its level costs no more than the budget."""
    nth = running(sizes, [F.col("source").asc_nulls_last()], {"nth": F.lit(1)}, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    leveled = nth.withColumn("weight", weight).drop("nth").withColumn("most", F.col("source_size") * float(max_epochs)).withColumn("level", F.col("most") / F.col("weight"))
    filled = materialise(running(leveled, [F.col("level"), F.col("source")], {"sum_most": F.col("most"), "sum_w": F.col("weight")}, "levels"), "filled")
    words, all_w = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_w = (words or 0) * float(budget), float(all_w or 0)
    held = filled.withColumn("held", F.col("sum_most") + F.col("level") * (all_w - F.col("sum_w")) <= total)
    full, left_w = held.agg(F.sum(F.when(F.col("held"), F.col("most"))), F.sum(F.when(~F.col("held"), F.col("weight")))).first()
    share = F.lit(total - (full or 0.0)) / float(left_w or 1) * F.col("weight")
    return held.select("source", "source_size", F.when(F.col("held"), F.col("most")).otherwise(F.least("most", share)).alias("target"))


def source_cuts(sized: DataFrame, weights: Sequence[float], budget: float, max_epochs: float, slices: int) -> DataFrame:
    """From (source, size, draw): for each source its size, target, whole ``epochs`` and where the rest of the target ends.

    That is in ``last_slice``: rows of smaller keys than ``cut_draw`` are taken, and ``cut_n`` of the ``ties`` that have it.
    """
    sliced = sized.withColumn("slice", slice_of("draw", slices))
    sums = materialise(sliced.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    targets = source_targets(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, budget, max_epochs)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = materialise(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    before = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")
    t, s = targets.alias("t"), sums.withColumn("before", before).alias("s")
    # the slices that the rest of the target reaches: all before its last are whole, and the last is looked into
    reached = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).where((F.col("s.before") < F.col("t.rest")) & (F.col("s.slice_size") > 0)).select(F.col("s.source").alias("source"), "slice", "before", "slice_size", "rest")
    last = reached.groupBy("source").agg(F.max_by(F.struct("slice", "before", "rest"), "slice").alias("last")).select("source", "last.*").alias("l")
    r = sliced.alias("r")
    inside = r.join(last, F.col("r.source").eqNullSafe(F.col("l.source")) & (F.col("r.slice") == F.col("l.slice"))).select("r.source", "size", "draw", "before", "rest")
    # rows of one key are equal: they stand as one row with their number
    units = inside.groupBy("source", "draw").agg(F.max("size").alias("size"), F.count("*").alias("ties"), F.max("before").alias("before"), F.max("rest").alias("rest"))
    words = F.col("size") * F.col("ties")
    units = units.withColumn("before", F.col("before") + F.sum(words).over(Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)) - words)
    # a row is taken if its middle lies before the end: the k-th of equal rows if before + k size - size / 2 < rest
    k = F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5)
    fits = lambda n: F.col("before") + n * F.col("size") - F.col("size") / 2 < F.col("rest")
    n = F.when(fits(k + 1), k + 1).when(fits(k), k).otherwise(k - 1)
    taken = units.where(F.col("size") > 0).withColumn("cut_n", F.least(n, "ties")).where("cut_n > 0")
    cuts = taken.groupBy("source").agg(F.max(F.struct("draw", "cut_n", "ties")).alias("cut"))
    # where the first document inside is too large, the cut is the end of the slice before
    l, c = last.select("source", F.col("slice").alias("last_slice")).alias("l"), cuts.alias("c")
    cut = l.join(c, F.col("l.source").eqNullSafe(F.col("c.source")), "left").select(F.col("l.source").alias("source"), "last_slice", F.col("cut.draw").alias("cut_draw"), F.col("cut.cut_n").alias("cut_n"), F.col("cut.ties").alias("ties")).alias("k")
    return t.join(cut, F.col("t.source").eqNullSafe(F.col("k.source")), "left").select(F.col("t.source").alias("source"), "source_size", "target", "epochs", "last_slice", "cut_draw", "cut_n", "ties")


def slice_of(draw: str, slices: int) -> Column:
    return F.floor((1 - F.exp(-F.col(draw))) * slices)


def drawn(docs: DataFrame, quality: Column | None, seed: int) -> list[Column]:
    """Source, size and key of each row."""
    quality = prose_weight(F.col("text")) if quality is None else quality
    return [F.col("source").alias("mix_source"), word_count(F.col("text")).alias("mix_size"), draw_key(F.col("doc_id"), F.col("text"), quality, seed).alias("mix_draw")]


def planned(sized: DataFrame, weights: Sequence[float], budget: float, max_epochs: float, slices: int | None) -> tuple[DataFrame, int]:
    """The cuts of a written table of (mix_source, mix_size, mix_draw), and how many slices there are: one for some 50,000 rows, or ``slices``."""
    slices = slices or max(4096, sized.count() // 50_000)
    named = sized.select(F.col("mix_source").alias("source"), F.col("mix_size").alias("size"), F.col("mix_draw").alias("draw"))
    return materialise(source_cuts(named, weights, budget, max_epochs, slices), "cuts"), slices


def with_copies(rows: DataFrame, cuts: DataFrame, slices: int) -> DataFrame:
    """``rows`` (with mix_source, mix_size and mix_draw) and their source_size, target and ``copies``; ``at_cut`` marks those of the key at which their source ends inside equal rows, which count as not taken."""
    few = cuts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(cuts) if few else cuts, rows["mix_source"].eqNullSafe(cuts["source"]), "left")
    at, within = slice_of("mix_draw", slices), F.col("mix_draw") == F.col("cut_draw")
    part = F.coalesce(within & (F.col("cut_n") < F.col("ties")), F.lit(False))
    more = F.coalesce((at < F.col("last_slice")) | ((at == F.col("last_slice")) & ((F.col("mix_draw") < F.col("cut_draw")) | within)), F.lit(False)) & ~part
    copies = F.when(F.col("mix_size") > 0, F.col("epochs") + more.cast("long")).otherwise(F.lit(0))
    return joined.select(*rows.columns, "source_size", "target", copies.alias("copies"), (part & (F.col("mix_size") > 0)).alias("at_cut"), "cut_n")


def settled(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` of ``with_copies`` with ``cut_n`` of the equal rows at each cut taken once more.

    Those rows, if there are any, are written with a number, and ranked within their source: within a task's rows, then over tasks.
    """
    done = rows.drop("at_cut", "cut_n")
    if cuts.where("cut_n < ties").isEmpty():
        return done
    tied = materialise(rows.where("at_cut").drop("at_cut").withColumn("mix_row", F.monotonically_increasing_id()), "tied")
    task = F.shiftright("mix_row", 33).alias("mix_task")
    n = tied.groupBy("mix_source", task).agg(F.count("*").alias("mix_n"))
    n = n.withColumn("mix_before", F.sum("mix_n").over(Window.partitionBy("mix_source").orderBy("mix_task")) - F.col("mix_n"))
    n = n.select(F.col("mix_source").alias("n_source"), F.col("mix_task").alias("n_task"), "mix_before")
    t = tied.withColumn("mix_task", task)
    t = t.join(n, t["mix_source"].eqNullSafe(n["n_source"]) & (t["mix_task"] == n["n_task"]))
    nth = F.col("mix_before") + F.row_number().over(Window.partitionBy("mix_source", "mix_task").orderBy("mix_row"))
    t = t.withColumn("copies", F.col("copies") + (nth <= F.col("cut_n")).cast("long"))
    return rows.where(~F.col("at_cut")).drop("at_cut", "cut_n").unionByName(t.select(*done.columns))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 17, slices: int | None = None, quality: Column | None = None) -> DataFrame:
    """``doc`` (a row of ``docs``) with mix_size, source_size, target and ``copies`` (how often the mix takes the document).

    ``weights`` go round the sources in their order; ``budget`` is the mix as a multiple of all words;
    ``quality`` (above 0) is a document's weight in the draw, ``prose_weight`` by default.
    The text is read twice, and not shuffled unless there are over ``BROADCAST_SOURCES`` sources.
    """
    asked = drawn(docs, quality, seed)
    cuts, slices = planned(materialise(docs.select(*asked), "sized"), weights, budget, max_epochs, slices)
    rows = with_copies(docs.select(F.struct(*docs.columns).alias("doc"), *asked), cuts, slices)
    return settled(rows, cuts).drop("mix_source", "mix_draw")


def mix_table(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 17, slices: int | None = None) -> DataFrame:
    """What the mix takes of each document, without the texts: doc_id, size, source_size, target, taken. The text is read once."""
    sized = materialise(docs.select("doc_id", *drawn(docs, None, seed)), "sized")
    cuts, slices = planned(sized, weights, budget, max_epochs, slices)
    rows = settled(with_copies(sized, cuts, slices), cuts)
    return rows.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, with the columns of ``docs``."""
    return mix_sources(docs, **options).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


#: DuckDB SQL for ``mix_table(documents)``.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17:' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
    / CASE WHEN length(text) > 0 THEN 0.25 + 0.75 * length(translate(text, '#$%&*+<=>@[]^_{|}~', '')) / length(text) ELSE 1.0 END AS draw
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0 * sum(size) AS most FROM sized GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM s0),
s2 AS (SELECT *, most / w AS level, 1.5 * sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM s1),
s3 AS (SELECT *, sum(most) OVER f + level * (all_w - sum(w) OVER f) <= total AS held FROM s2 WINDOW f AS (ORDER BY level, source NULLS FIRST ROWS UNBOUNDED PRECEDING)),
s4 AS (SELECT *, total - coalesce(sum(CASE WHEN held THEN most END) OVER (), 0) AS spare, sum(CASE WHEN NOT held THEN w END) OVER () AS spare_w FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN held THEN most ELSE least(most, spare / spare_w * w) END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM s5),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN s6 t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (epochs + CASE WHEN upto - size / 2.0 < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
