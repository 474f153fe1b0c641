"""Embedding near-duplicates by a subspace pigeonhole join, among vectors of one label.

For unit vectors a cosine of c is a squared distance of 2 - 2c. Vectors are rotated and split into subspaces; two vectors
within the distance must, in one subspace at least, lie within that subspace's share of it (in proportion to its dimensions).

Each subspace is range-joined by itself, on its own coordinates alone. A tree of median splits, grown on a bounded sample,
cuts it into cells; a vector is at home in one cell and visits those that its share's root reaches. Cells that no split
would thin out are not cut further. A cell's vectors are dealt into tiles of bounded size, and tile meets tile, so that a
hot cell is spread over many tasks. A meeting names the rows that have a partner within the share; only for those are the
whole vectors fetched, the union of candidates verified by exact cosines, and each pair counted once: in the first subspace
that brings it together. A task gives counts of links and a forest rather than pairs: as many rows as vectors read.

Equal vectors of a label are one class until the end, so that copies cost no comparisons.

Nulls and edges: vectors that are null, zero or non-finite, and those without a label, link with nothing; vectors link with
those of their own length alone; a repeated vec_id is one vector for each of its rows with links counted for each, under the
one id; a null vec_id takes part, and names a component only where there is no other; an empty table gives an empty table;
other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, skew_join
from .components import components
from .vectors import matrix, sound

TILE = 2048
#: Rows of the sample on which the trees of cells are grown, and the fewest of them that a cell is cut for.
SAMPLE, LEAST_CUT = 16_384, 128
#: A split is worth while if at most this share of a cell's vectors would stand on both sides.
WORTH = 0.7
SLACK = 1e-6  # of coordinates, which are dealt in single precision
CELLS = "cell string, part int, visits int, row long, z binary"
MEETING = "meeting string, part int, self boolean, role int, row long"
FOUND = "row long, n long, root long"


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Subspaces as (first, end) of the rotated coordinates."""
    cut = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def reaches(dim: int, cosine: float, parts: int) -> list[float]:
    """How far apart two linked vectors may be in the subspace that has them within its share."""
    return [math.sqrt((2 - 2 * cosine) * (b - a) / dim) + SLACK for a, b in bounds(dim, parts)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def grown(z: np.ndarray, reach: float) -> list[tuple[int, float, int, int]]:
    """A tree as nodes (axis, cut, lower child, upper child), a cell as (-1, 0, its number, 0); the root comes first."""
    nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, 0, 0)]
    todo, cells = [(0, np.arange(len(z)))], 1
    while todo:
        at, rows = todo.pop()
        if len(rows) < LEAST_CUT:
            continue
        cuts = np.median(z[rows], axis=0)
        both = (np.abs(z[rows] - cuts) <= reach).mean(axis=0)
        axis = int(both.argmin())
        low = z[rows, axis] < cuts[axis]
        if both[axis] > WORTH or not low.any():
            continue
        number = nodes[at][2]
        nodes[at] = (axis, float(cuts[axis]), len(nodes), len(nodes) + 1)
        todo += [(len(nodes), rows[low]), (len(nodes) + 1, rows[~low])]
        nodes += [(-1, 0.0, number, 0), (-1, 0.0, cells, 0)]
        cells += 1
    return nodes


def placed(tree: list[tuple[int, float, int, int]], z: np.ndarray, reach: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, rows, whether each is at home there) for all cells that have rows."""
    todo = [(0, np.arange(len(z)), np.ones(len(z), bool))]
    while todo:
        at, rows, home = todo.pop()
        if not len(rows):
            continue
        axis, cut, below, above = tree[at]
        if axis < 0:
            yield below, rows, home
            continue
        x = z[rows, axis]
        low = x < cut
        for child, inside in ((below, low), (above, ~low)):
            goes = inside | (np.abs(x - cut) <= reach)
            todo.append((child, rows[goes], home[goes] & inside[goes]))


def cells(batches: Iterator[pa.RecordBatch], cosine: float, parts: int, trees: dict[int, list]) -> Iterator[pa.RecordBatch]:
    """For each vector and subspace: its coordinates, at home in their cell and for each cell that they visit."""
    for batch in batches:
        if not batch.num_rows:
            continue
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            some = batch.filter(pa.array(dims == dim))
            y = unit(matrix(some.column("embedding"))) @ rotation(dim)
            row, label = some.column("row").to_numpy(), np.array(some.column("label").cast(pa.string()).to_pylist())
            for s, ((a, b), reach) in enumerate(zip(bounds(dim, parts), reaches(dim, cosine, parts), strict=True)):
                z = y[:, a:b].astype("<f4")
                for cell, at, home in placed(trees[dim][s], y[:, a:b], reach):
                    named = pa.array([f"{label[i]}/{dim}/{s}/{cell}" for i in at], pa.string())
                    yield pa.RecordBatch.from_arrays([named, pa.array(np.full(len(at), s), pa.int32()), pa.array(1 - home.astype(int), pa.int32()), pa.array(row[at]), pa.array([z[i].tobytes() for i in at], pa.binary())], ["cell", "part", "visits", "row", "z"])


def tiles(dealt: DataFrame, tile: int) -> DataFrame:
    """(meeting, part, self, role, row, z): role 0 is the tile at home, 1 another tile at home in the cell, 2 a tile of visitors.

    Homes and visitors of a cell are dealt into tiles by hash. Tile i meets itself and the first visitors in one meeting,
    each later home tile and each further tile of visitors in one more.
    """
    n = dealt.groupBy("cell").agg(F.sum((F.col("visits") == 0).cast("long")).alias("homes"), F.sum("visits").alias("guests"), F.count("*").alias("n"))
    up = lambda c: F.greatest(F.ceil(F.col(c) / tile), F.lit(1)).cast("int")
    t = skew_join(dealt, materialise(n.where("homes > 0").select("cell", up("homes").alias("th"), up("guests").alias("tv"), "n"), "sizes"), "cell")
    t = t.withColumn("own", F.pmod(F.xxhash64("row"), F.when(F.col("visits") == 0, F.col("th")).otherwise(F.col("tv"))).cast("int"))
    meet = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    homes, to_home, to_guest = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("th", "th", "tv"))
    at_home = F.concat(
        F.transform(F.filter(to_home, lambda j: j >= F.col("own")), lambda j: meet(F.col("own"), j, 0)),
        F.transform(F.filter(to_home, lambda j: j < F.col("own")), lambda j: meet(j, F.col("own"), 1)),
        F.transform(F.filter(to_guest, lambda v: v > 0), lambda v: meet(F.col("own"), F.col("th") + v, 0)),
    )
    visiting = F.transform(homes, lambda i: meet(i, F.when(F.col("own") == 0, i).otherwise(F.col("th") + F.col("own")), 2))
    t = t.select("cell", "part", "row", "z", F.explode(F.when(F.col("visits") == 0, at_home).otherwise(visiting)).alias("m"))
    return t.select(F.concat_ws("/", "cell", "m.i", "m.j").alias("meeting"), "part", (F.col("m.i") == F.col("m.j")).alias("self"), "m.role", "row", "z")


def meeting_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Places that meet: those at home among themselves (each pair once), and with the others."""
    role = table.column("role").to_numpy()
    home = np.flatnonzero(role == 0)
    if table.column("self")[0].as_py():
        yield home, home, True
    yield home, np.flatnonzero(role > 0), False


def brought(i: np.ndarray, j: np.ndarray, rows: np.ndarray, role: np.ndarray, inner: bool) -> np.ndarray:
    """Whether a pair counts here: it meets in the homes of both ends, and counts in that of the lesser row."""
    return i < j if inner else (role[j] == 1) | (rows[i] < rows[j])


def near(table: pa.Table, dim_of, cosine: float, parts: int) -> pa.Table:
    """The rows of a meeting that have a partner within the subspace's share."""
    role, rows, part = table.column("role").to_numpy(), table.column("row").to_numpy(), table.column("part")[0].as_py()
    z = np.frombuffer(b"".join(table.column("z").to_pylist()), "<f4").reshape(len(rows), -1)
    limit = reaches(dim_of(table), cosine, parts)[part] ** 2 + 1e-5
    sq, hit = np.einsum("ij,ij->i", z, z), np.zeros(len(rows), bool)
    for left, right, inner in meeting_pairs(table):
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            p, q = np.nonzero(sq[some][:, None] + sq[right][None] - 2 * (z[some] @ z[right].T) <= limit)
            i, j = some[p], right[q]
            ok = brought(i, j, rows, role, inner)
            hit[i[ok]] = hit[j[ok]] = True
    return table.select(["meeting", "part", "self", "role", "row"]).filter(pa.array(hit))


def met(table: pa.Table, cosine: float, parts: int) -> pa.Table:
    """Rows (row, links found here, least row linked here) of one meeting."""
    role, rows, part = table.column("role").to_numpy(), table.column("row").to_numpy(), table.column("part")[0].as_py()
    copies = table.column("copies").to_numpy()
    raw = matrix(table.column("embedding").combine_chunks())
    y = unit(raw)
    spans, norm = bounds(raw.shape[1], parts), np.sqrt(np.einsum("ij,ij->i", raw, raw))
    z = y @ rotation(raw.shape[1])
    share = [(2 - 2 * cosine + 1e-9) * (b - a) / raw.shape[1] for a, b in spans]
    n, ends = np.zeros(len(rows), np.int64), []
    for left, right, inner in meeting_pairs(table):
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            p, q = np.nonzero(y[some] @ y[right].T >= cosine - 1e-9)
            i, j = some[p], right[q]
            ok = brought(i, j, rows, role, inner)
            i, j = i[ok], j[ok]
            apart = [((z[i, a:b] - z[j, a:b]) ** 2).sum(axis=1) <= share[s] for s, (a, b) in enumerate(spans[: part + 1])]
            ok = apart[part] & (np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= cosine)
            for earlier in apart[:part]:
                ok &= ~earlier
            i, j = i[ok], j[ok]
            n += np.bincount(i, copies[j], minlength=len(rows)).astype(np.int64) + np.bincount(j, copies[i], minlength=len(rows)).astype(np.int64)
            ends.append((i.astype(np.int32), j.astype(np.int32)))
    i, j = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
    order = np.argsort(rows)
    root = np.empty(len(rows), np.int64)  # ranks, so that the least row of a component is found
    root[order] = np.arange(len(rows))
    while len(i):
        before, low = root.copy(), np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[order[root]]
        if (root == before).all():
            break
    at = np.flatnonzero(n)
    return pa.table({"row": rows[at], "n": n[at], "root": rows[order[root[at]]]}, pa.schema([("row", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))


def meeting_dim(table: pa.Table) -> int:
    return int(table.column("meeting")[0].as_py().split("/")[-5])


def candidates(reps: DataFrame, cosine: float, parts: int, tile: int) -> DataFrame:
    """``MEETING`` rows: those that have a partner within a subspace's share, in each meeting that shows it."""
    sample = reps.select("dim", "embedding").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow()
    trees: dict[int, list] = {d: [grown(np.zeros((0, b - a)), 1.0) for a, b in bounds(d, parts)] for d in [r[0] for r in reps.select("dim").distinct().collect()]}
    for dim in set(sample.column("dim").to_pylist()):
        some = sample.filter(pa.array(sample.column("dim").to_numpy() == dim))
        y = unit(matrix(some.column("embedding").combine_chunks())) @ rotation(dim)
        trees[dim] = [grown(y[:, a:b], reach) for (a, b), reach in zip(bounds(dim, parts), reaches(dim, cosine, parts), strict=True)]
    dealt = materialise(reps.select("label", "row", "dim", "embedding").mapInArrow(lambda x: cells(x, cosine, parts, trees), CELLS), "cells")
    return materialise(tiles(dealt, tile).groupBy("meeting").applyInArrow(lambda t: near(t, meeting_dim, cosine, parts), MEETING), "near")


def vector_classes(vectors: DataFrame, cosine: float = 0.93, parts: int = 4, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding, label)."""
    base = materialise(vectors.select("vec_id", "embedding", "label").withColumn("row", F.monotonically_increasing_id()), "vectors")
    usable = sound(base, "label", "row").where("label is not null")
    # a vector's text tells its numbers exactly, so equal keys are equal vectors but for an md5
    key = F.md5(F.concat_ws(":", F.col("label").cast("string"), F.to_json("embedding")))
    keyed = materialise(usable.select("row", "vec_id", key.alias("key")), "keyed")
    classes = materialise(keyed.groupBy("key").agg(F.min("row").alias("row"), F.min("vec_id").alias("least_id"), F.count("*").alias("copies")), "classes")
    reps = materialise(usable.select("row", "label", "dim", "embedding").join(classes.select("row", "copies"), "row"), "reps")
    whole = candidates(reps, cosine, parts, tile).join(reps.select("row", "copies", "embedding"), "row")
    found = materialise(whole.groupBy("meeting").applyInArrow(lambda t: met(t, cosine, parts), FOUND), "found")
    links = found.groupBy("row").agg(F.sum("n").alias("links"))
    part = materialise(components(found.select("row", "root"), "row", "root").withColumnsRenamed({"node": "row", "component": "first_row"}), "parts")
    named = classes.join(links, "row", "left").join(part, "row", "left").withColumn("first_row", F.coalesce("first_row", "row"))
    named = materialise(named.select("key", "first_row", "least_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    least = materialise(named.groupBy("first_row").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")), "least")
    told = materialise(skew_join(named.drop("least_id"), least, "first_row").select("key", "copies", "n_links", "component_id"), "told")
    rows = skew_join(keyed, told, "key", "copies").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    out = keyed.select("row")
    alone = base.select("row", "vec_id").join(out, "row", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
