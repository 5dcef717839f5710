"""Plans are what they are meant to be: pruned scans, top k without a full sort, no Python in JVM operators."""

from __future__ import annotations

import pytest

from paperloom.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(catalog.year_filter(spark, sf_dir))
    assert "GreaterThanOrEqual(year,2010)" in text and "ReadSchema: struct<id:bigint,year:int>" in text


@pytest.mark.parametrize("name", ["vector_topk", "search_bm25", "search_keyword_weighted"])
def test_top_k_does_not_sort_the_corpus(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan(catalog.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["p5_found", "nested_departments", "pairs_title_trgm", "record_upsert", "krippendorff_alpha", "merged_fields"])
def test_stays_in_the_jvm(spark, sf_dir, name):
    text = plan(catalog.queries()[name](spark, sf_dir))
    assert "Python" not in text and "InPandas" not in text and "CartesianProduct" not in text


def test_nested_is_one_pass(spark, sf_dir):
    text = plan(catalog.p5_found(spark, sf_dir))
    assert text.count("FileScan") == 1 and "Exchange" not in text


def test_nothing_wide_is_read_for_groups(spark, sf_dir):
    assert "embedding" not in plan(catalog.publication_rank(spark, sf_dir))
