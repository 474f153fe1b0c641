"""Whitening of embeddings by matrix-free block Lanczos.

The covariance is never formed. A pass over the vectors gives its product with a block of columns: each task sums
x'(x q) over its centred rows x, and the tasks' sums, ``length x block`` numbers each, are added up by a grouping on the
cell. The driver keeps the basis and its products, of ``length x basis`` numbers, whatever the number of vectors.

Each block is orthogonalised twice against the whole basis. Columns that vanish (the block has met an invariant subspace)
are replaced by random ones orthogonal to all others. A full basis is restarted from its best Ritz vectors, whose
products are known, and goes on with the last remainder. The components are accepted when all their residuals are below
``tolerance`` times the largest eigenvalue and a further random block, orthogonal to the basis, does not change them, so
that eigenvalues of higher multiplicity than the block are not missed; a basis of all dimensions is exact.

Components become integers x = floor(64 c) + 1000000. With their sums S over n vectors, n x - S is exact; centred rows are
that divided by n, so nothing is lost to a mean far from zero. Squares of n x - S add up to each row's deviation, and
the deviations' total is the trace that shares are taken of.

Nulls and edges: rows whose vector is null, empty, or holds null or non-finite entries take no part, nor those of another
length than most have (of equally frequent lengths the greatest has). Zero vectors and repeated rows count, a null vec_id is
kept. Entries beyond 2^56 count as that (x near 2^62); a deviation that no long holds is null. There are as many
components as the covariance has eigenvalues above rounding, 32 at most: none, so no rows, for an empty table or equal
vectors. Other columns are left alone. The vectors are read in each pass; give a stored table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import chunks, finite, length_most_have, matrix

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
Product = Callable[[np.ndarray], np.ndarray]


def integers(batch: pa.RecordBatch) -> np.ndarray:
    """floor(64 c) + 1000000 of each component, within 2^62 of it."""
    return np.clip(np.floor(64.0 * matrix(batch.column("embedding"))), -(2.0**62), 2.0**62).astype(np.int64) + 1_000_000


@dataclass
class Centre:
    """n vectors whose sums are ``n * whole + rest`` in each dimension; ``wide`` if n x - S may be beyond 64 bits."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    wide: bool

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        kind = object if self.wide else np.int64
        return self.n * (x.astype(kind) - self.whole.astype(kind)) - self.rest.astype(kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.spread(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2 for each row, exact."""
        t = self.spread(x)
        if t.dtype != object and np.square(t.astype(np.float64)).sum(axis=1).max(initial=0) >= 2.0**62:
            t = t.astype(object)
        return [int(v) for v in (t * t).sum(axis=1)]


def centre_of(vectors: DataFrame) -> Centre:
    """The exact sums of all vectors, which have one length."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, least, most = 0, 0, None, None
        for batch in chunks(batches):
            x = integers(batch)
            n += len(x)
            total = total + (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & 0x7FFFFFFF).sum(axis=0).astype(object)
            least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
            most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        if n:
            cells = range(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0)), pa.array(least), pa.array(most)], ["cell", "n", "s", "least", "most"])

    found = vectors.select("embedding").mapInArrow(sums, "cell int, n long, s decimal(38,0), least long, most long")
    rows = sorted(found.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("least").alias("least"), F.max("most").alias("most")).collect())
    n = rows[0].n
    whole, rest = zip(*(divmod(int(r.s), n) for r in rows), strict=True)
    reach = max(max(r.most - w, w - r.least) for r, w in zip(rows, whole, strict=True)) + 1
    return Centre(n, np.array(whole), np.array(rest), n * reach >= 1 << 62)


def summed(vectors: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what ``part`` gives for the integers of a slice of them: ``size`` numbers."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in chunks(batches):
            got = part(integers(batch)).ravel()
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["cell", "v"])

    out = np.zeros(size)
    for cell, v in vectors.select("embedding").mapInArrow(of_task, "cell int, v double").groupBy("cell").agg(F.sum("v")).collect():
        out[cell] = v
    return out


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, small: float) -> np.ndarray:
    """``block`` made orthonormal, also to ``basis``; columns no longer than ``small`` give way to random ones."""
    out = basis
    for k in range(min(block.shape[1], len(basis) - basis.shape[1])):
        v, least = block[:, k], small
        while True:
            before = np.linalg.norm(v)
            for _ in range(2):
                v = v - out @ (out.T @ v)
            if np.linalg.norm(v) > max(least, 1e-10 * before):
                break
            v, least = rng.normal(size=len(basis)), 0.0  # breakdown: go on with another direction
        v = v / np.linalg.norm(v)
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, basis.shape[1] :]


def largest_eigenpairs(product: Product, size: int, count: int, block: int = 16, most: int | None = None, tolerance: float = 1e-13, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their eigenvectors (columns) of a symmetric ``size x size`` operator without negative ones.

    ``product(q)`` multiplies it with a block of columns. The basis holds ``most`` columns at most.
    """
    rng = np.random.default_rng(seed)
    count, block = min(count, size), min(block, size)
    most = min(size, max(most or 4 * count, count + 2 * block))
    basis, images = np.zeros((size, 0)), np.zeros((size, 0))
    new, known, before = orthonormal(rng.normal(size=(size, block)), basis, rng, 0.0), None, []
    for _ in range(100 + 20 * size // block):
        image = product(new)
        basis, images = np.column_stack([basis, new]), np.column_stack([images, image])
        values, vectors = np.linalg.eigh((m := basis.T @ images) / 2 + m.T / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        ritz = basis @ vectors[:, :count]
        worst = np.linalg.norm(images @ vectors[:, :count] - ritz * values[:count], axis=0).max()
        scale = max(abs(values[0]), np.finfo(float).tiny)
        if basis.shape[1] == size:
            return values[:count], ritz
        before.append(worst)
        level = worst <= 1e-10 * scale and len(before) > 6 and worst > min(before[-6:-3]) / 2  # rounding is all that is left
        settled = basis.shape[1] >= count and (worst <= tolerance * scale or level)
        if settled and known is not None and np.abs(values[:count] - known).max() <= 1e-10 * scale:
            return values[:count], ritz
        rest = image - basis @ (basis.T @ image)
        known = values[:count].copy() if settled else None
        if basis.shape[1] + block > most:
            keep = vectors[:, : max(count, most - 2 * block)]
            basis, images = basis @ keep, images @ keep
        new = orthonormal(rng.normal(size=(size, block)) if settled else rest, basis, rng, 1e-13 * scale)
    raise ArithmeticError(f"no convergence: residual {worst / scale:.3g}")


def whitened(vectors: DataFrame, components: int = 32, block: int = 16) -> DataFrame:
    """A row for each vector that takes part and each component: its whitened value, deviation and the component's share of the variance."""
    spark = vectors.sparkSession
    rows = finite(vectors)
    size = length_most_have(rows)
    rows = rows.where(F.size("embedding") == size)
    if not size:
        return spark.createDataFrame([], OUT)
    centre = centre_of(rows)
    n, trace = centre.n, []

    def product(q: np.ndarray) -> np.ndarray:
        first = not trace

        def part(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return np.r_[(c.T @ (c @ q)).ravel(), sum(centre.deviations(x)) / n / n if first else 0.0]

        got = summed(rows, part, q.size + 1)
        trace[len(trace) :] = [got[-1] / n] if first else []
        return got[:-1].reshape(q.shape) / n

    values, axes = largest_eigenpairs(product, size, components, block)
    there = values > size * np.finfo(float).eps * max(values[0], 0.0)
    values, axes = values[there], axes[:, there]
    k = len(values)
    if not k:
        return spark.createDataFrame([], OUT)
    scaled, shares = axes / np.sqrt(values), values / trace[0]

    def moments(x: np.ndarray) -> np.ndarray:
        z = centre.centred(x) @ scaled
        return np.r_[(z.T @ z).ravel(), z.sum(axis=0)]

    got = summed(rows, moments, k * k + k)
    mean = got[k * k :] / n
    error = float(np.abs(got[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 18):
            x = integers(batch)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            deviations = pa.array([d if d < 1 << 63 else None for d in centre.deviations(x)], pa.int64())
            arrays = [batch.column("vec_id").cast(pa.int64()).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)), deviations.take(at)]
            arrays += [pa.array((centre.centred(x) @ scaled).ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(len(at), error))]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "embedding").mapInArrow(emit, OUT)
