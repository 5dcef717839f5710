"""The indexes give what the scans give, and read their terms' and cells' files only."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperloom.operators import index, search
from paperloom.session import read_table
from tests.test_operators import paper, papers

DIM = 384


@pytest.fixture(scope="module")
def built(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    p = read_table(spark, sf_dir, "papers")
    index.build_postings(p, path)
    index.build_cells(p, path, DIM, lists=4)
    q = [float(x) for x in search.sound_vectors(p, DIM).orderBy("id").first()["embedding"]]
    return path, p, q


def rows(df):
    return [(r.id, round(r.score, 9)) for r in df.collect()]


@pytest.mark.parametrize("text", ["screening", "citation triage", '"citation triage" OR reranker -dental', "records -screening", "the", "xqzzy", "xqzzy OR screening", '"of the records"'])
def test_postings_equal_the_scan(spark, built, text):
    path, p, _ = built
    assert rows(index.search_postings(spark, path, text)) == rows(search.bm25(p, text))
    assert rows(index.search_postings(spark, path, text, low=2012, high=2018)) == rows(search.bm25(p, text, low=2012, high=2018))


def test_all_cells_equal_the_scan(spark, built):
    path, p, q = built
    assert rows(index.search_cells(spark, path, q, 10, probes=4)) == rows(search.vector_topk(p, q, 10))
    assert len(rows(index.search_cells(spark, path, q, 30, probes=1, low=2015, high=2016))) == min(30, search.sound_vectors(p.where("year between 2015 and 2016"), DIM).count())


def test_a_query_reads_its_files_only(spark, built):
    path, _, q = built
    plan = index.search_postings(spark, path, "citation triage")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term, [citation,triage])" in plan and "title_words" not in plan
    plan = index.search_cells(spark, path, q, 1, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_search_modes_and_refusals(spark, built):
    path, p, q = built
    for mode in index.MODES:
        got = index.search(spark, path, p, "screening", q, mode, k=5).orderBy("rank").collect()
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and all(a["score"] >= b["score"] for a, b in zip(got, got[1:], strict=False))
    for bad in (dict(mode="other"), dict(k=0), dict(k=50, depth=20), dict(text=" "), dict(query=None), dict(low=2020, high=2010)):
        with pytest.raises(ValueError):
            index.search(spark, path, p, **{"text": "a", "query": q, **bad})


def test_empty_table(spark, tmp_path):
    p = papers(spark, paper(1, "x")).where("false")
    index.build_postings(p, str(tmp_path))
    index.build_cells(p, str(tmp_path), 2)
    assert index.search_postings(spark, str(tmp_path), "x").count() == 0 and index.search_cells(spark, str(tmp_path), [1.0, 0.0]).count() == 0


def test_rows_without_vector_or_text(spark, tmp_path):
    p = papers(spark, paper(1, "alpha", embedding=[1.0, 0.0]), paper(2, "", embedding=[0.0, 0.0]), paper(3, "beta", year=None, embedding=None))
    index.build_postings(p, str(tmp_path))
    index.build_cells(p, str(tmp_path), 2)
    assert [r.id for r in index.search_postings(spark, str(tmp_path), "alpha OR beta").orderBy("id").collect()] == [1, 3]
    assert [r.id for r in index.search_postings(spark, str(tmp_path), "beta", low=1).select("id").where(F.lit(True)).collect()] == []
    assert [r.id for r in index.search_cells(spark, str(tmp_path), [1.0, 0.0]).collect()] == [1]
