"""Each query of the catalog against its SQL on the smallest tables."""

from __future__ import annotations

import pandas as pd
import pytest

from lodestone import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(name, spark, data, duck):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (df[cols].sort_values(cols).reset_index(drop=True).astype(object).where(lambda x: x.notna(), None) for df in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"chapter_matches"}
