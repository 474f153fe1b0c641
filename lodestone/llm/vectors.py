"""What the operators on ``embeddings`` share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sound(vectors: DataFrame, *more: str) -> DataFrame:
    """vec_id, embedding, ``dim`` (its length) and ``more`` of the rows that take part.

    A vector that is null, empty or zero, or holds a null or non-finite component, does not. Vectors of different lengths
    have no product: operators compare those of one length.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = vectors.select("vec_id", "embedding", *more).where(x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda c: c != 0))
    return usable.withColumn("dim", F.size("embedding"))


def finite(vectors: DataFrame, *more: str) -> DataFrame:
    """vec_id, embedding and ``more`` of the rows whose vector has components and none that is null, NaN or infinite; zeros stay."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.select("vec_id", "embedding", *more).where(F.coalesce(whole, F.lit(False)) & (F.size(x) > 0))


def length_most_have(vectors: DataFrame) -> int:
    """The length that most vectors have, of equally frequent ones the greatest; 0 without vectors."""
    first = vectors.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return first.dim if first else 0


def chunks(batches: Iterable[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose ``embedding`` has about ``most`` components at most."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, most * batch.num_rows // max(1, len(batch.column("embedding").flatten())))
            yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)


def lists(rows: list[np.ndarray] | np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of arrays."""
    ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if len(rows) else [], kind))
