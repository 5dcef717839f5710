from __future__ import annotations

import pytest

from paperloom.llm import catalog
from tests.oracle_compare import connect, difference


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - {"p4_matches", "p7_raters", "p10_segments"}))
def test_runs(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert len(rows) == len({tuple(map(str, r)) for r in rows})


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    assert difference(spark, connect(sf_dir), catalog.queries()[name], catalog.oracle_sql()[name], sf_dir) is None
