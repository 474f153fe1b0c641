"""What the operators of this folder share: tables in the shared folder, Arrow batches, words and hashes."""

from __future__ import annotations

import gc
import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import session_folder

#: A word is a longest run of characters other than ASCII white space; ``bytes.split()`` finds the same runs in UTF-8.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: this cuts the lineage, and a lost executor costs no recomputation.

    Shuffle files of the jobs that made the table are let go of.
    """
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return kept


def skew_join(rows: DataFrame, table: DataFrame, key: str, n: str = "n", how: str = "inner", hot: int = 1000) -> DataFrame:
    """``rows`` joined with ``table`` (written, one row a key), whose column ``n`` says how many of ``rows`` have the key.

    Keys with over a ``hot``-th of all rows are fewer than ``hot``: their side of the table is broadcast, so that their rows
    stay where they are. The others are joined by shuffling, and no task gets more than a ``hot``-th for one key.
    """
    limit = (table.agg(F.sum(n)).first()[0] or 0) // hot
    heavy = F.broadcast(table.where(F.col(n) > limit))
    if heavy.isEmpty():
        return rows.join(table, key, how)
    rest = rows.join(heavy.select(key), key, "left_anti").join(table.where(F.col(n) <= limit), key, how)
    return rows.join(heavy, key).unionByName(rest)


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes at most; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8"))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 texts; null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


class WordHashes:
    """64-bit hashes of words (without white space), for all words of a list at once.

    A byte stands for a number of its own; a word's hash is the polynomial of its bytes' numbers, as a difference of running
    sums over the joined words, moved to the word's start and mixed. A word of over ``longest`` bytes is hashed by itself.
    """

    chunk, longest = 1 << 16, 1 << 20
    _base = 0x9E3779B97F4A7C15
    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, seed: int = 0):
        self.seed = seed
        self.numbers = mix(np.arange(256, dtype=U64) + U64(1000 * (seed + 1)))

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse, ``n`` of them at least."""
        if len(cls._powers[0]) < n:
            found = []
            for base in (cls._base, pow(cls._base, -1, 1 << 64)):
                p = np.full(1 << (n - 1).bit_length(), base, np.uint64)
                p[0] = 1
                found.append(np.multiply.accumulate(p))
            cls._powers = tuple(found)
        return cls._powers

    def of(self, words: list[bytes]) -> np.ndarray:
        parts = [self._of(words[at : at + self.chunk]) for at in range(0, len(words), self.chunk)]
        return np.concatenate(parts) if parts else np.zeros(0, U64)

    def _of(self, words: list[bytes]) -> np.ndarray:
        joined = b"\n".join(words) + b"\n"
        if len(joined) > self.longest:
            half = len(words) // 2
            return np.concatenate([self._of(words[:half]), self._of(words[half:])]) if half else np.array([xxhash.xxh64_intdigest(words[0], self.seed)], U64)
        raw = np.frombuffer(joined, np.uint8)
        ends = np.flatnonzero(raw == 10)
        up, down = self.powers(len(raw))
        x = self.numbers[raw]
        x[ends] = 0
        x *= up[: len(raw)]
        return mix(np.diff(np.cumsum(x, dtype=U64)[ends], prepend=U64(0)) * down[np.r_[0, ends[:-1] + 1]])


def flat(split: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """All words of several texts in one list, and how many each text has."""
    lens = np.fromiter(map(len, split), np.int64, len(split))
    return list(itertools.chain.from_iterable(split)), lens


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, for each element of a uint64 array."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = U64(0xD6E8FEB86659FD93)


def power(n: int) -> np.uint64:
    return U64(pow(int(BASE), n, 1 << 64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of ``n`` neighbouring word hashes, for each start; built by doubling."""
    span, got = 1, h
    out, done = None, 0
    while span <= n:
        if n & span:
            # ``got`` covers ``span`` words from each start; put it after what is covered already
            if out is None:
                out, done = got, span
            else:
                m = max(0, len(h) - done - span + 1)
                out, done = out[:m] * power(span) + got[done : done + m], done + span
        m = max(0, len(got) - span)
        got, span = got[:m] * power(span) + got[span : span + m], span * 2
    return out[: max(0, len(h) - n + 1)]


def remainder(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
