"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled by the largest norm and get one more coordinate that brings them all to norm 1, so that the largest inner
product is the smallest Euclidean distance. A table hashes a vector by a few Gaussian projections: each is cut into steps of
one width from a random offset, floor((a x + b) / w), the outermost steps being open. There are more projections where there
are more vectors, so that a bucket holds some ``per_bucket`` of them, as long as a table has ``MOST_BUCKETS`` at most.

A query visits its own bucket in each table, then perturbed ones in the order of their estimated success (the least squared
distance from its projections to the bucket's steps; buckets that no vector has are passed over), until the buckets seen hold
a share of all vectors. That share is fitted: the true neighbours, among all vectors, of a bounded sample of queries are
found by brute force, and the least share that reaches ``recall`` on them is taken. What the tables find is merged and ranked
by exact inner products in double precision.

The directory of occupied buckets is bounded and is the only thing that every task gets. Buckets are packed into blocks of
bounded size, and a larger bucket is spread over several. A vector goes once to its block of each table; a query goes once to
each block that holds a bucket of its list. A block's vectors come first and its queries stream past them, so that a task
holds one block whatever the number of queries; only for each ``PIECE`` queries more is a block dealt once more.

Nulls and edges: vectors that are null, zero or non-finite take no part, as candidates or queries; vectors of different
lengths have no inner product and are searched apart; a vector with a null vec_id is no query, but is found, after others of
its score; a query never finds its own row, but does find another row with its vec_id; ties go to the smaller vec_id; a query
gets fewer than ``k`` rows only where there are fewer candidates; an empty table gives an empty table; other columns are left
alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import lists, matrix, sound

#: Rows of the sample that steps are fitted on, and queries whose true neighbours the number of probes is fitted on.
SAMPLE, SAMPLE_QUERIES = 4096, 256
MOST_BUCKETS = 60_000
#: Vectors of a block; queries that a block takes before it is dealt once more; queries compared at once.
BLOCK, PIECE, AT_ONCE = 4096, 200_000, 256
SHARES = (0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0)
NO_ID = (1 << 63) - 1  # stands for a null vec_id, so that it comes last
DEALT = "block int, piece int, kind int, row long, vec_id long, buckets array<int>, vector binary"
FOUND = "query long, scores array<double>, ids array<long>, rows array<long>"


@dataclass
class Index:
    """Projections, steps and, once counted, the directory of buckets of each table."""

    top: float
    planes: np.ndarray  # tables x projections x (dim + 1)
    cuts: np.ndarray  # tables x projections x (steps - 1)
    share: float = 1.0
    codes: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    first_block: list[np.ndarray] = field(default_factory=list)
    n_blocks: list[np.ndarray] = field(default_factory=list)

    @property
    def base(self) -> int:
        return self.cuts.shape[2] + 1

    def raised(self, x: np.ndarray) -> np.ndarray:
        x = x / self.top
        return np.c_[x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1)))]

    def bucket(self, x: np.ndarray, t: int) -> np.ndarray:
        """The bucket of each vector in a table, as one number."""
        p = self.raised(x) @ self.planes[t].T
        return ((p[:, :, None] >= self.cuts[t][None]).sum(axis=2) * self.base ** np.arange(p.shape[1])).sum(axis=1)

    def costs(self, q: np.ndarray, t: int) -> np.ndarray:
        """Squared distance of each query's projections to each occupied bucket: small ones succeed more often, 0 is its own."""
        p = np.c_[q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))] @ self.planes[t].T
        digits = self.codes[t][:, None] // self.base ** np.arange(p.shape[1]) % self.base
        out = np.zeros((len(q), len(digits)))
        for j in range(p.shape[1]):
            edge = np.r_[-np.inf, self.cuts[t][j], np.inf]
            away = np.maximum(0, np.maximum(edge[:-1][None] - p[:, j, None], p[:, j, None] - edge[1:][None]))
            out += (away**2)[:, digits[:, j]]
        return out

    def before(self, q: np.ndarray, t: int) -> np.ndarray:
        """queries x buckets: the vectors in the buckets that a query visits before this one."""
        order = np.argsort(self.costs(q, t), axis=1, kind="stable")
        out = np.empty(order.shape, np.int64)
        np.put_along_axis(out, order, np.cumsum(self.counts[t][order], axis=1) - self.counts[t][order], axis=1)
        return out

    def visited(self, q: np.ndarray, t: int, least: int) -> np.ndarray:
        """queries x buckets: whether a query visits the bucket."""
        return self.before(q, t) < max(self.share * self.counts[t].sum(), least)


def stepped(sample: np.ndarray, top: float, n: int, tables: int, steps: int, width: float, per_bucket: int, seed: int = 3) -> Index:
    """Projections and their steps, ``width`` standard deviations wide, for ``n`` vectors."""
    rng = np.random.default_rng(seed)
    projections = max(1, int(np.log(min(MOST_BUCKETS, max(steps, n / per_bucket))) / np.log(steps)))
    planes = rng.normal(size=(tables, projections, sample.shape[1] + 1))
    index = Index(top, planes, np.zeros((tables, projections, steps - 1)))
    for t in range(tables):
        p = index.raised(sample) @ planes[t].T
        offset = rng.uniform(-0.5, 0.5, size=(projections, 1))
        index.cuts[t] = p.mean(axis=0)[:, None] + width * p.std(axis=0)[:, None] * (np.arange(steps - 1)[None] - (steps - 2) / 2 + offset)
    return index


def with_share(index: Index, queries: np.ndarray, truth: list[tuple[int, np.ndarray]], recall: float) -> Index:
    """The least share of vectors to visit that finds ``recall`` of the true neighbours: (place of the query, vector)."""
    of, x = np.array([i for i, _ in truth], np.int64), np.array([v for _, v in truth])
    seen = np.full(len(of), np.inf)
    for t in range(len(index.planes)):
        place = np.searchsorted(index.codes[t], index.bucket(x, t))
        for at in range(0, len(queries), 32):
            mine = np.flatnonzero((of >= at) & (of < at + 32))
            share = index.before(queries[at : at + 32], t)[of[mine] - at, place[mine]] / max(1, index.counts[t].sum())
            seen[mine] = np.minimum(seen[mine], share)
    index.share = next((s for s in SHARES if (seen < s).mean() >= recall), 1.0)
    return index


def with_directory(index: Index, counted: list[tuple[int, int, int]], block: int) -> Index:
    """Put the buckets of all vectors, (table, bucket, number), into blocks."""
    base = 0
    for t in range(len(index.planes)):
        own = sorted((b, n) for table, b, n in counted if table == t)
        n = np.array([x[1] for x in own])
        index.codes.append(np.array([x[0] for x in own]))
        index.counts.append(n)
        ends = np.cumsum(n)
        first = (ends - n) // block
        index.first_block.append(base + first)
        index.n_blocks.append(np.where(n > block, (ends - 1) // block - first + 1, 1))
        base += int((first + index.n_blocks[-1]).max()) if len(n) else 0
    return index


def bucket_rows(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("embedding"))
            for t in range(len(index.planes)):
                b, n = np.unique(index.bucket(x, t), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), t), pa.int32()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["t", "bucket", "n"])


def dealt(batches: Iterator[pa.RecordBatch], index: Index, k: int, pieces: int) -> Iterator[pa.RecordBatch]:
    """Rows for the blocks: kind 0 a vector with its bucket, kind 1 a query with the buckets that it visits there."""

    def rows(block, piece, kind, row, vec_id, buckets: pa.ListArray, vectors):
        m = len(row)
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(piece, pa.int32()), pa.array(np.full(m, kind), pa.int32()), pa.array(row, pa.int64()), pa.array(vec_id, pa.int64()), buckets, pa.array(vectors, pa.binary())], ["block", "piece", "kind", "row", "vec_id", "buckets", "vector"])

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            x, row, vec_id = matrix(part.column("embedding")), part.column("row").to_numpy(), part.column("vec_id").to_numpy()
            raw = [v.tobytes() for v in x]
            asks = np.flatnonzero(part.column("asks").to_numpy(zero_copy_only=False))
            for t in range(len(index.planes)):
                place = np.searchsorted(index.codes[t], index.bucket(x, t))
                block = index.first_block[t][place] + row % index.n_blocks[t][place]
                for c in range(pieces):
                    yield rows(block, np.full(len(x), c), 0, row, vec_id, lists(list(place[:, None]), pa.int32()), raw)
                for some in np.array_split(asks, len(asks) // AT_ONCE + 1) if len(asks) else []:
                    i, j = np.nonzero(index.visited(x[some], t, k + 44))
                    n = index.n_blocks[t][j]
                    i, j = np.repeat(i, n), np.repeat(j, n)
                    b = index.first_block[t][j] + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)
                    order = np.lexsort((j, b, i))
                    i, j, b = i[order], j[order], b[order]
                    new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (b[1:] != b[:-1])])
                    who = some[i[new]]
                    seen = pa.ListArray.from_arrays(pa.array(np.r_[new, len(j)], pa.int32()), pa.array(j, pa.int32()))
                    yield rows(b[new], row[who] % pieces, 1, row[who], vec_id[who], seen, [raw[w] for w in who])


def best_of(q: np.ndarray, own: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, sees: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the query, scores, ids, rows) of the ``k`` best for each query that has any; ``sees`` says which vectors it looks at."""
    score = q @ x.T
    out = own[:, None] == rows[None]
    score[out if sees is None else out | ~sees] = -np.inf
    kth = -np.partition(-score, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
    i, j = np.nonzero((score >= kth[:, None] - 1e-9 * np.maximum(1, np.abs(kth[:, None]))) & (score > -np.inf))
    exact = np.einsum("ij,ij->i", q[i], x[j])
    order = np.lexsort((rows[j], ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    ends = np.searchsorted(i, np.arange(len(q) + 1))
    for s, (a, b) in enumerate(zip(ends[:-1], np.minimum(ends[1:], ends[:-1] + k), strict=True)):
        if b > a:
            yield s, exact[a:b], ids[j[a:b]], rows[j[a:b]]


def found_rows(got: list[tuple]) -> pa.RecordBatch:
    query, scores, ids, rows = zip(*got, strict=True) if got else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), lists([-s for s in scores], pa.float64()), lists(list(ids), pa.int64()), lists(list(rows), pa.int64())], ["query", "scores", "ids", "rows"])


def in_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each query of a block its ``k`` best there. Rows come sorted by (block, piece, kind): vectors, then the queries that look at them."""
    key, held, x, at_bucket = None, [], None, None
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(start, AT_ONCE)
            blocks, pieces, kinds = (part.column(c).to_numpy() for c in ("block", "piece", "kind"))
            cut = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (pieces[1:] != pieces[:-1]) | (kinds[1:] != kinds[:-1])])
            for a, b in zip(cut, np.r_[cut[1:], len(blocks)], strict=True):
                run = part.slice(int(a), int(b - a))
                if key != (blocks[a], pieces[a]):
                    key, held, x = (blocks[a], pieces[a]), [], None
                row, ids = run.column("row").to_numpy(), run.column("vec_id").to_numpy()
                bucket = run.column("buckets")
                q = np.frombuffer(b"".join(run.column("vector").to_pylist())).reshape(len(row), -1)
                if kinds[a] == 0:
                    held.append((q, row, ids, bucket.flatten().to_numpy()))
                    continue
                if not held:
                    continue
                if x is None:
                    x = [np.concatenate(c) for c in zip(*held, strict=True)]
                    names, at_bucket = np.unique(x[3], return_inverse=True)
                sees = np.zeros((len(row), len(names)), bool)
                flat = bucket.flatten().to_numpy()
                of = np.repeat(np.arange(len(row)), np.diff(bucket.offsets.to_numpy()))
                place = np.minimum(np.searchsorted(names, flat), len(names) - 1)
                here = names[place] == flat
                sees[of[here], place[here]] = True
                got = [(row[s], *best) for s, *best in best_of(q, row, x[0], x[1], x[2], k, sees[:, at_bucket])]
                if got:
                    yield found_rows(got)


def by_brute_force(batches: Iterator[pa.RecordBatch], queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield found_rows([(s, *best) for s, *best in best_of(queries, own, matrix(part.column("embedding")), part.column("row").to_numpy(), part.column("vec_id").to_numpy(), k)])


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query, best): the ``k`` best of each query, from short lists; merged in parts first."""
    lists_ = found.select("query", F.arrays_zip(F.col("scores").alias("s"), F.col("ids").alias("v"), F.col("rows").alias("r")).alias("best"))
    best = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k).alias("best")
    return lists_.groupBy("query", F.pmod(F.hash(F.col("best")[0]["r"]), F.lit(32)).alias("salt")).agg(best("best")).groupBy("query").agg(best("best"))


def fitted(held: DataFrame, n: int, top: float, k: int, recall: float, tables: int, steps: int, width: float, per_bucket: int, block: int) -> Index:
    """The index over ``held`` (row, vec_id, embedding, asks), ``n`` rows of one length."""
    some = lambda rows, m: rows.select("row", "embedding").orderBy(F.xxhash64("row"), "row").limit(m).collect()
    index = stepped(np.array([r[1] for r in some(held, SAMPLE)], "f8"), top, n, tables, steps, width, per_bucket)
    counted = held.select("embedding").mapInArrow(lambda x: bucket_rows(x, index), "t int, bucket long, n long").groupBy("t", "bucket").agg(F.sum("n").alias("n")).collect()
    index = with_directory(index, [tuple(r) for r in counted], block)
    asked = some(held.where("asks"), SAMPLE_QUERIES)
    queries, own = np.array([r[1] for r in asked], "f8"), np.array([r[0] for r in asked], np.int64)
    near = merged(held.mapInArrow(lambda x: by_brute_force(x, queries, own, k), FOUND), k).select("query", F.explode("best.r").alias("row"))
    truth = [(r[0], np.array(r[1], "f8")) for r in near.join(held, "row").select("query", "embedding").collect()]  # k for each query of the sample
    return with_share(index, queries, truth, recall) if truth else index


def nearest(vectors: DataFrame, asks: Column, k: int = 20, recall: float = 0.96, tables: int = 2, steps: int = 3, width: float = 1.0, per_bucket: int = 8, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, embedding) that ``asks`` marks, against all rows.

    ``recall`` is asked for on the sample of queries; ``tables``, ``steps``, ``width`` and ``per_bucket`` shape the index.
    """
    spark = vectors.sparkSession
    numbered = sound(vectors.withColumn("row", F.monotonically_increasing_id()).withColumn("asks", F.coalesce(asks & F.col("vec_id").isNotNull(), F.lit(False))), "row", "asks")
    held = materialise(numbered.withColumn("vec_id", F.coalesce("vec_id", F.lit(NO_ID))), "vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    # a length of vectors is searched by itself; there are few lengths, as a rule one
    per_dim = held.groupBy("dim").agg(F.max(norm).alias("top"), F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asks")).where("asks > 0").orderBy("dim").collect()
    found = [spark.createDataFrame([], FOUND)]
    for dim, top, n, n_asks in per_dim:
        own = held.where(F.col("dim") == dim)
        index = fitted(own, n, float(top), k, recall, tables, steps, width, per_bucket, block)
        pieces = -(-n_asks // PIECE)
        met = own.mapInArrow(lambda x, index=index, pieces=pieces: dealt(x, index, k, pieces), DEALT)
        found.append(met.repartition("block", "piece").sortWithinPartitions("block", "piece", "kind").mapInArrow(lambda x: in_blocks(x, k), FOUND))
    ranked = merged(reduce(DataFrame.unionByName, found), k).select("query", F.posexplode("best").alias("at", "b"))
    names = held.where("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.nullif("b.v", F.lit(NO_ID)).alias("vec_id"), (-F.col("b.s")).alias("score"))
