"""Hard negatives by product quantisation with stored residual norms.

Vectors of integers are cut into subspaces of ``width`` components. A codebook for each subspace, trained on a bounded sample,
gives every row a byte a subspace and the norm of what the centroid leaves over there, rounded up. For an anchor, tables hold
its products with all centroids; a row's score is the sum of its entries, and lies within the sum of the products of the
anchor's and the residual's norms (Cauchy-Schwarz in each subspace, rounding added). So a row is left out only if that
bound proves that it cannot be among those asked for, and what is left is ranked by exact integer products. The codebook
therefore changes the work and never the result.

Rows and anchors are dealt evenly into packs of bounded size, whatever their labels; each pack of anchors meets each pack of rows once,
in a tile, first for the positives and then, with the windows they open, for the negatives. A tile returns a few rows for each
anchor and window, which are ranked over all tiles. Work is anchors x rows, as the exact result over unstructured
vectors needs; memory of a task is one tile.

Nulls and edges: rows with a null id or label, or a vector that is null, empty or holds null or non-finite components take no part, nor
those of another length than most have (of equally frequent lengths the greatest has). Zero vectors count. Other rows are those of
another vec_id. A repeated row is a row as any other, as a positive and as a negative; an anchor repeated with the same label and
vector gives its rows once, with another label or vector it is another anchor. A positive score below zero has an empty window.
Components are held within +-2^((62 - log2 length) / 2), so that a long holds every score. An empty table gives an empty
table; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import chunks, finite, length_most_have, matrix

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int"
PACK_ROWS, PACK_ANCHORS, TOGETHER = 4096, 4096, 128
#: Packs of anchors (under a megabyte each at 64 dimensions) that a task of tiles holds.
TOGETHER_PACKS = 32


class Codebook:
    """Centroids of each subspace, float32 of shape (subspaces, centroids, width)."""

    def __init__(self, sample: np.ndarray, width: int, centroids: int = 256, rounds: int = 6, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.width = width
        parts = self.split(sample.astype("f8"))
        k = min(centroids, len(sample))
        start = rng.permutation(len(sample))[:k]
        self.centres = np.stack([self.fitted(x, x[start], rounds) for x in parts]).astype("f4")

    @staticmethod
    def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin(np.square(centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)

    def fitted(self, x: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            code = self.nearest(x, centres)
            n = np.bincount(code, minlength=len(centres))
            sums = np.stack([np.bincount(code, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        return centres

    def split(self, x: np.ndarray) -> np.ndarray:
        """(subspaces, rows, width), the last subspace filled up with zeros."""
        more = -x.shape[1] % self.width
        return np.pad(x, ((0, 0), (0, more))).reshape(len(x), -1, self.width).transpose(1, 0, 2)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A code and a residual's norm (float64) for each row and subspace."""
        codes, norms = [], []
        for part, centres in zip(self.split(x.astype("f8")), self.centres.astype("f8"), strict=True):
            codes.append(self.nearest(part, centres))
            norms.append(np.linalg.norm(part - centres[codes[-1]], axis=1))
        return np.stack(codes, axis=1).astype("u1"), np.stack(norms, axis=1)

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products with all centroids (subspaces, centroids, anchors), anchors' norms (subspaces, anchors), and what float32 sums may be off by."""
        parts = self.split(anchors.astype("f8"))
        exact = np.einsum("mkw,maw->mka", self.centres.astype("f8"), parts)
        off = (len(exact) + 2) * np.finfo("f4").eps * np.abs(exact).max(axis=1).sum(axis=0)
        return exact.astype("f4"), (np.linalg.norm(parts, axis=2) * (1 + 1e-5)).astype("f4"), off


def pack_of(columns: dict[str, np.ndarray], slot: int) -> pa.RecordBatch:
    """One row: a slot, the number of rows, and each array as bytes with its kind."""
    names, arrays = ["slot", "n"], [pa.array([slot], pa.int32()), pa.array([len(next(iter(columns.values())))], pa.int32())]
    for name, x in columns.items():
        names += [name, f"{name}_kind"]
        arrays += [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), pa.array([x.dtype.str])]
    return pa.RecordBatch.from_arrays(arrays, names)


def pack_schema(names: str) -> str:
    return "slot int, n int" + "".join(f", {name} binary, {name}_kind string" for name in names.split())


def unpacked(row: dict, names: str) -> dict[str, np.ndarray]:
    out = {name: np.frombuffer(row[name], row[f"{name}_kind"]) for name in names.split()}
    return {k: v.reshape(row["n"], -1) if k in ("x", "codes", "steps", "scores") else v for k, v in out.items()}


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype("<i2") if np.abs(x).max(initial=0) < 1 << 15 else x


ROWS, ANCHORS = "id label x codes steps step", "anchor id label x scores"


def packer(most: int, made: Callable[[list[pa.RecordBatch]], dict[str, np.ndarray]]):
    """An Arrow function that makes packs of ``most`` rows; their slot is the partition's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, slot = [], 0, TaskContext.get().partitionId()
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                part = whole.slice(at, most - n)
                held, n, at = [*held, part], n + part.num_rows, at + part.num_rows
                if n == most:
                    yield pack_of(made(held), slot)
                    held, n = [], 0
        if held:
            yield pack_of(made(held), slot)

    return run


def row_packs(rows: DataFrame, book: Codebook, n: int) -> DataFrame:
    def made(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(batches).combine_chunks()
        label = table["label"].to_numpy().astype("<i8")
        order = np.argsort(label, kind="stable")
        x = matrix(table["embedding"].chunk(0))[order].astype("<i4")
        codes, norms = book.encode(x)
        step = max(norms.max(), 1e-30) / 254
        steps = np.ceil(norms / step * (1 + 1e-9)).astype("u1")
        return {"id": table["vec_id"].to_numpy()[order].astype("<i8"), "label": label[order], "x": narrow(x), "codes": codes, "steps": steps, "step": np.full(len(x), step)}

    return rows.repartition(-(-n // PACK_ROWS)).mapInArrow(packer(PACK_ROWS, made), pack_schema(ROWS))


def anchor_packs(anchors: DataFrame, n: int) -> DataFrame:
    """``scores`` of an anchor: those of its positives, -1 where there is none."""

    def made(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(batches).combine_chunks()
        found = {name: table[name].to_numpy().astype("<i8") for name in ("anchor", "label")}
        scores = matrix(table["scores"].chunk(0)).astype("<i8") if len(table["scores"].chunk(0).flatten()) else np.zeros((len(table), 0), "<i8")
        return {"anchor": found["anchor"], "id": table["vec_id"].to_numpy().astype("<i8"), "label": found["label"], "x": narrow(matrix(table["embedding"].chunk(0)).astype("<i4")), "scores": scores}

    return anchors.select("anchor", "vec_id", "label", "embedding", "scores").repartition(-(-n // PACK_ANCHORS)).mapInArrow(packer(PACK_ANCHORS, made), pack_schema(ANCHORS))


def over_tiles(packs: DataFrame, anchors: DataFrame, slots: int, count: int, work: Callable[[dict, dict], Iterator[dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """``work`` on each pack of anchors with each pack of rows.

    A task has one pack of rows and up to ``TOGETHER_PACKS`` packs of anchors, which it reads where they were dealt: no pack is repeated
    for its tiles, and none is broadcast, whatever Spark takes its table's size to be.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                mine = unpacked({k[2:]: v for k, v in row.items() if k.startswith("a_")}, ANCHORS)
                for out in work(mine, unpacked(row, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(out[name]) for name in names], names)

    theirs = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns)).repartition(-(-count // (PACK_ANCHORS * TOGETHER_PACKS)))
    return packs.repartition(slots).crossJoin(theirs.hint("shuffle_replicate_nl")).mapInArrow(run, schema)


class Tile:
    """Scores with bounds of some anchors against some rows of a pack."""

    def __init__(self, book: Codebook, anchors: dict, rows: dict):
        self.book, self.anchors, self.rows = book, anchors, rows
        reach = float(np.abs(anchors["x"].astype("i8")).max(initial=0)) * float(np.abs(rows["x"].astype("i8")).max(initial=0)) * rows["x"].shape[1]
        kind = "f8" if reach < 2.0**53 else "i8"
        self.a, self.x = anchors["x"].astype(kind), rows["x"].astype(kind)

    def bounds(self, which: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest possible score, (rows, anchors)."""
        tables, norms, off = self.book.tables(self.anchors["x"][which])
        codes = self.rows["codes"][part]
        score = np.take(tables[0], codes[:, 0], axis=0)
        more = np.empty_like(score)
        for m in range(1, len(tables)):
            score += np.take(tables[m], codes[:, m], axis=0, out=more)
        step = self.rows["step"][0] if len(self.rows["step"]) else 0.0
        error = self.rows["steps"][part].astype("f4") @ (norms * np.float32(step * (1 + 1e-5)))
        error += (off * (1 + 1e-5)).astype("f4")
        return score - error * np.float32(1 + 1e-4), score + error * np.float32(1 + 1e-4)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Integer products of rows ``i`` and anchors ``j``."""
        step = max(1, (1 << 22) // self.x.shape[1])
        parts = [np.einsum("ij,ij->i", self.x[i[at : at + step]], self.a[j[at : at + step]]) for at in range(0, len(i), step)]
        return np.concatenate(parts).astype("i8") if parts else np.zeros(0, "i8")


def firsts(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.searchsorted(g, g)
    return order[np.arange(len(g)) - start < most]


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest of each column, minus infinity where there are fewer rows."""
    return np.partition(x, len(x) - k, axis=0)[len(x) - k] if len(x) >= k else np.full(x.shape[1], -np.inf, x.dtype)


def positives_of(book: Codebook, most: int):
    """The first ``most`` other rows of an anchor's label within a tile."""

    def work(anchors: dict, rows: dict) -> Iterator[dict[str, np.ndarray]]:
        tile = Tile(book, anchors, rows)
        for label in np.unique(anchors["label"]):
            part = slice(*np.searchsorted(rows["label"], (label, label + 1)))
            same = np.flatnonzero(anchors["label"] == label)
            for at in range(0, len(same) if part.stop > part.start else 0, TOGETHER):
                which = same[at : at + TOGETHER]
                low, high = tile.bounds(which, part)
                other = rows["id"][part][:, None] != anchors["id"][which][None]
                i, j = np.nonzero(other & (high >= kth_largest(np.where(other, low, -np.inf), most)))
                i, j = i + part.start, which[j]
                score = tile.exact(i, j)
                kept = firsts(j, score, rows["id"][i], most)
                i, j = i[kept], j[kept]
                yield {"anchor": anchors["anchor"][j], "anchor_id": anchors["id"][j], "positive_id": rows["id"][i], "positive_score": score[kept]}

    return work


def negatives_of(book: Codebook, most: int, least: int, below: int):
    """The first ``most`` rows of other labels in each window of each anchor within a tile; windows in hundredths of the positive's score."""

    def work(anchors: dict, rows: dict) -> Iterator[dict[str, np.ndarray]]:
        tile = Tile(book, anchors, rows)
        for at in range(0, len(anchors["anchor"]), TOGETHER):
            which = np.arange(at, min(at + TOGETHER, len(anchors["anchor"])))
            low, high = tile.bounds(which, slice(None))
            other = rows["label"][:, None] != anchors["label"][which][None]
            positive = anchors["scores"][which]
            bottom, top = np.where(positive < 0, 1, -(-least * positive // 100)), np.where(positive < 0, 0, below * positive // 100)
            wanted = np.zeros(low.shape, bool)
            for p in range(positive.shape[1]):
                b, t = bottom[:, p].astype("f8"), top[:, p].astype("f8")
                possible = other & (high >= b) & (low <= t) & (b <= t)
                sure = possible & (low >= b) & (high <= t)
                many = np.flatnonzero(sure.sum(axis=0) >= most)
                if len(many):
                    possible[:, many] &= high[:, many] >= kth_largest(np.where(sure[:, many], low[:, many], -np.inf), most)
                wanted |= possible
            i, j = np.nonzero(wanted)
            score = tile.exact(i, which[j])
            for p in range(positive.shape[1]):
                inside = np.flatnonzero((score >= bottom[j, p]) & (score <= top[j, p]))
                kept = inside[firsts(j[inside], score[inside], rows["id"][i[inside]], most)]
                if len(kept):
                    yield {"anchor": anchors["anchor"][which[j[kept]]], "positive_rank": np.full(len(kept), p + 1, "i4"), "negative_id": rows["id"][i[kept]], "negative_score": score[kept]}

    return work


def first_by_hash(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """The vectors of the first ``most`` of ``n`` rows by a hash of their id. Each task sends its own first to the driver, so rows are picked
    by that hash before: about twice as many as asked for; where ids repeat and too few are met, all rows are asked."""
    order = [F.xxhash64("vec_id"), F.col("vec_id")]
    first = lambda some: some.orderBy(*order).limit(most).select("embedding").collect()
    below = min(2.0 * most / n, 1.0) * 2.0**64 - 2.0**63
    found = first(rows.where(order[0].cast("double") < below))
    if len(found) < min(most, n):
        found = first(rows)
    return np.array([r.embedding for r in found])


def hard_negatives(vectors: DataFrame, anchor: F.Column, label: F.Column | None = None, positives: int = 5, negatives: int = 3, least: int = 50, below: int = 95, width: int = 2, sample: int = 4096) -> DataFrame:
    """For each row that ``anchor`` picks and each of its first ``positives``, the first ``negatives`` rows of other labels whose
    score is from ``least`` to ``below`` hundredths of the positive's. ``label``: the label to use instead of the column's.
    ``sample``: how many rows, the first by a hash of their id, the codebook is trained on."""
    spark = vectors.sparkSession
    rows = finite(vectors, "label").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    size = length_most_have(rows)
    if not size:
        return spark.createDataFrame([], OUT)
    most = float(1 << (62 - math.ceil(math.log2(size))) // 2)
    whole = F.transform("embedding", lambda c: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(c.cast("double") * 256).cast("double"))).cast("int"))
    rows = rows.where(F.size("embedding") == size).select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), whole.alias("embedding"))
    rows = materialise(rows.where(F.col("label").isNotNull()), "integers")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], OUT)
    book = Codebook(first_by_hash(rows, n, sample), width)
    packs, slots = materialise(row_packs(rows, book, n), "packs"), -(-n // PACK_ROWS)
    anchors = materialise(rows.where(anchor).dropDuplicates(["vec_id", "label", "embedding"]).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    count = anchors.count()
    if not count:
        return spark.createDataFrame([], OUT)
    asked = anchor_packs(anchors.withColumn("scores", F.array().cast("array<long>")), count)
    found = over_tiles(packs, asked, slots, count, positives_of(book, positives), "anchor long, anchor_id long, positive_id long, positive_score long")
    nearest = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
    found = materialise(found.withColumn("positive_rank", nearest).where(F.col("positive_rank") <= positives), "positives")
    scores = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_score"))).alias("s"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda k: F.coalesce(F.get(F.col("s.positive_score"), k), F.lit(-1)))
    asked = anchor_packs(anchors.join(scores, "anchor").withColumn("scores", filled), count)
    hard = over_tiles(packs, asked, slots, count, negatives_of(book, negatives, least, below), "anchor long, positive_rank int, negative_id long, negative_score long")
    first = F.row_number().over(Window.partitionBy("anchor", "positive_rank").orderBy(F.desc("negative_score"), "negative_id"))
    hard = hard.withColumn("rank", first).where(F.col("rank") <= negatives)
    return hard.join(found, ["anchor", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


MINED_SQL = """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT a.vec_id AS anchor_id, a.label, r.vec_id, r.label AS other, list_dot_product(a.x, r.x)::BIGINT AS score
  FROM q a JOIN q r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
  FROM p WHERE label = other QUALIFY positive_rank <= 5)
SELECT pos.anchor_id, positive_id, row_number() OVER (PARTITION BY pos.anchor_id, positive_rank ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score, positive_rank::INTEGER AS positive_rank
FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND label <> other AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
