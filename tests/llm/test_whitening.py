"""Whitening against a dense eigendecomposition, with exact deviations."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import whitening
from lodestone.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string"


def check(got, rows, components=32):
    """Compare with integers, exact fractions and a dense eigendecomposition."""
    ids = [i for i, _ in rows]
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    t = n * x - s
    centred = (t / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * k
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {})[r.component] = r
    trace = float(sum(Fraction(int(v), n**3) for v in (t * t).sum(axis=1)))
    out = np.zeros((n, k))
    for i, (vec_id, deviation) in enumerate(zip(ids, (t * t).sum(axis=1), strict=True)):
        found = table[vec_id]
        assert sorted(found) == list(range(1, k + 1))
        for c, r in found.items():
            assert (r.n, r.deviation) == (n, deviation if deviation < 2**63 else None)
            assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-9) and r.identity_error < 1e-8
            out[i, c - 1] = r.whitened
    want = centred @ (axes[:, :k] / np.sqrt(values[:k]))
    flips = np.sign((out * want).sum(axis=0))
    distinct = [j for j in range(k) if min([abs(values[j] - values[m]) for m in (j - 1, j + 1) if 0 <= m < len(values)], default=1) > 1e-6 * values[0]]
    assert len(distinct) and np.abs(out * flips - want)[:, distinct].max() < 1e-7
    assert np.abs(out.T @ out / n - np.eye(k)).max() < 1e-8


def rows_of(x, first=0):
    return [(first + i, v.tolist(), 0, "clash", "clash") for i, v in enumerate(x.astype("f4"))]


def test_rows_with_all_edges(spark):
    rng = np.random.default_rng(0)
    rows = rows_of(rng.normal(size=(120, 40)) @ np.diag(np.linspace(0.01, 1, 40)))
    good = [(r[0], r[1]) for r in rows] + [(500, [0.0] * 40)]
    bad = [(500, [0.0] * 40, 1, "", ""), (600, None, 0, "", ""), (601, [None] + [1.0] * 39, 0, "", ""), (602, [float("nan")] * 40, 0, "", ""), (603, [float("inf")] * 40, 0, "", ""), (604, [1.0] * 39, 0, "", ""), (605, [], 0, "", "")]
    check(whitening.whitened(spark.createDataFrame(rows + bad, SCHEMA).repartition(5)).collect(), good)
    assert whitening.whitened(spark.createDataFrame(rows + [(None, [0.5] * 40, 0, "", "")] * 3, SCHEMA)).where("vec_id is null").count() == 96
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([rows[3]] * 5, SCHEMA)).count() == 0


def test_components_no_long_holds(spark):
    """Products beyond 64 bits are made in whole numbers; a deviation that no long holds is null."""
    x = np.random.default_rng(1).normal(size=(30, 3)) * np.array([1e9, 1e7, 1e8])
    got = whitening.whitened(spark.createDataFrame(rows_of(x), SCHEMA)).collect()
    assert None in {r.deviation for r in got}
    check(got, [(r[0], r[1]) for r in rows_of(x)])


def test_query_over_the_whole_table(spark, data):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect())
    check(op12_whitening(spark, data).collect(), rows)


def dense(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("values, count, block, most", [
    (np.linspace(1, 2, 200), 8, 4, None),  # a small basis with restarts
    (0.8 ** np.arange(300), 32, 16, None),
    (np.r_[[5.0] * 40, [1.0] * 80], 32, 16, 96),  # two eigenvalues: breakdown after two blocks, multiplicity over the block
    (np.r_[[9.0, 8.0], [0.0] * 60], 5, 2, None),  # rank two
    (np.ones(50), 10, 4, None),
    (np.linspace(1, 3, 20), 20, 16, None),  # the basis fills all dimensions
])
def test_largest_eigenpairs(values, count, block, most):
    m = dense(values)
    widths = []

    def product(q):
        widths.append(q.shape[1])
        return m @ q

    e, v = whitening.largest_eigenpairs(product, len(values), count, block, most)
    assert np.abs(e - np.sort(values)[::-1][:count]).max() < 1e-11 * values.max()
    assert np.abs(m @ v - v * e).max() < 1e-9 * values.max() and np.abs(v.T @ v - np.eye(count)).max() < 1e-12
    assert max(widths) <= block
