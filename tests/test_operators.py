from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import evaluation, groups, pairs, screening, search, stats
from paperloom.sources import records as rec

PAPERS = "id long, title string, title_norm string, abstract string, year int, venue string, doi string, arxiv_id string, pubmed_id string, citation_count int, is_retracted boolean, authors array<string>, embedding array<float>, created_at timestamp"


def paper(i, title, **k):
    base = dict(title_norm=title.lower(), abstract=None, year=2020, venue=None, doi=None, arxiv_id=None, pubmed_id=None, citation_count=0, is_retracted=False, authors=["A Smith"], embedding=None, created_at=dt.datetime(2024, 1, 1))
    return (i, title, *{**base, **k}.values())


def papers(spark, *rows):
    return spark.createDataFrame(list(rows), PAPERS)


def test_query_parser():
    q = search.parse_query('alpha "beta gamma" OR delta -eps the')
    assert q.groups == [[["alpha"]], [["beta", "gamma"], ["delta"]]] and q.excluded == [["eps"]]
    assert search.parse_query("the of").groups == [] and search.parse_query('"').groups == []


def test_keyword_match_and_ties(spark):
    p = papers(spark, paper(1, "Reranking notes"), paper(2, "x", abstract="reranking here"), paper(3, "Other"), paper(4, "Reranking notes"))
    assert [r.id for r in search.keyword_weighted(p, "reranking").collect()] == [1, 4, 2]
    assert search.keyword_weighted(p, "the").count() == 0
    assert [r.id for r in search.bm25(p, "reranking -notes").collect()] == [2]
    assert [r.id for r in search.cover_density(p, "reranking notes").collect()] == [1, 4]


def test_hybrid_geometry(spark):
    near, far = [1.0, 0.0], [-1.0, 0.1]
    p = papers(spark, paper(1, "both here", embedding=near), paper(2, "other", embedding=[0.9, 0.1]), paper(3, "both", embedding=far), paper(4, "zero", embedding=[0.0, 0.0]), paper(5, "none"))
    fused = {r.id: (r.keyword_rank, r.vector_rank, r.pool) for r in search.fuse(search.bm25(p, "both", 10), search.vector_topk(p, near, 10), 10).collect()}
    assert set(fused) == {1, 2, 3} and fused[2][0] is None and fused[1][1] == 1 and fused[1][2] == 3
    top = search.hybrid(p, "both", near, k=2).orderBy(F.desc("score")).collect()
    assert top[0].id in (1, 3) and len(top) == 2 and "keyword" in top[0].sources
    assert [r.id for r in search.ivf_topk(p, near, 3, lists=2, probes=1).collect()] == [1, 2, 3]
    batch = search.vector_batch_topk(p, p.where("id = 1"), 2, 2).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in batch] == [(1, 1), (1, 2)]


def test_year_filter_drops_null(spark):
    p = papers(spark, paper(1, "a", year=None), paper(2, "b", year=2015))
    assert [r.id for r in p.where(search.year_between(2010, None)).collect()] == [2]
    assert p.where(search.year_between()).count() == 2


def test_stars_and_fuzzy_pairs(spark):
    long = "a long title about screening records in wards"
    p = papers(
        spark, paper(1, long, doi="10.1/x", abstract="same text"), paper(2, long + "s", abstract="same text"), paper(3, long, doi="10.1/x"), paper(4, "short", arxiv_id="1"), paper(5, "short two", arxiv_id="1", year=2021)
    )
    as_set = lambda df: {(r.a, r.b) for r in df.collect()}
    assert as_set(pairs.doi_exact(p)) == {(1, 3)}
    assert as_set(pairs.title_exact(p)) == {(1, 3)}
    assert as_set(pairs.id_exact(p)) == {(4, 5)}
    assert as_set(pairs.abstract_title(p)) == {(1, 2)}
    assert as_set(pairs.merge_ready(pairs.title_trgm(p), p)) == {(1, 2), (2, 3)}
    assert {(r.a, r.b): r.strategy for r in pairs.attributed(pairs.all_pairs(p)).collect()}[(1, 3)] == "doi_exact"


def test_supplements_do_not_merge(spark):
    t = "additional file {} of a study of ward notes"
    p = papers(spark, paper(1, t.format(1)), paper(2, t.format(3)), paper(3, "a study of ward notes"))
    assert pairs.merge_ready(pairs.title_trgm(p, 0.5), p, 0.5).count() == 0


def test_components_and_verdicts(spark):
    e = spark.createDataFrame([(1, 2, 1.0, "doi_exact"), (3, 2, 0.95, "title_trgm"), (5, 6, 1.0, "title_exact"), (6, 7, 1.0, "title_exact"), (9, 9, 1.0, "doi_exact")], "a long, b long, sim double, strategy string")
    m = groups.components(e)
    assert {r.id: r.root for r in m.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5}
    held = spark.createDataFrame([(3,)], "id long")
    v = {r.root: (r.strategy, r.verdict) for r in groups.group_verdict(groups.group_strategy(e, m), m, held).collect()}
    assert v == {1: ("doi_exact", "withheld"), 5: ("title_exact", "flagged")}
    assert groups.components(e.where("false")).count() == 0


def test_long_chain(spark):
    e = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    m = groups.components(e)
    assert m.count() == 201 and m.agg(F.max("root")).first()[0] == 0


def test_chain_in_no_order(spark):
    """A chain whose ids rise and fall has many local minima: plain propagation needs 304 rounds."""
    ids = list(range(400))
    random.Random(5).shuffle(ids)
    e = spark.createDataFrame([*zip(ids, ids[1:]), (1000, 1001)], "a long, b long")
    assert {r.id: r.root for r in groups.components(e).collect()} == {i: 0 for i in ids} | {1000: 1000, 1001: 1000}


def test_merge_and_roll_back(spark):
    p = papers(spark, paper(1, "preprint", doi="10.1/preprints.1", citation_count=9), paper(2, "published", venue="J", abstract="z"), paper(3, "alone"))
    r = spark.createDataFrame([(1, "arxiv", 1)], "id long, source string, paper_id long")
    m = spark.createDataFrame([(1, 1), (2, 1)], "id long, root long")
    chosen = groups.survivors(m, groups.publication_rank(p, r))
    assert [tuple(x) for x in chosen.collect()] == [(1, 2)]
    merged = groups.merged_fields(p, m, chosen)
    row = merged.first()
    assert (row.title, row.doi, row.citation_count) == ("published", "10.1/preprints.1", 9)
    after = groups.apply_merge(p, merged, groups.mapping(m, chosen))
    assert {x.id for x in after.collect()} == {2, 3}
    back = groups.roll_back(after, groups.merge_snapshot(p, m, chosen))
    want = p.select("id", *groups.FIELDS)
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0


def test_screening_numbers(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, i, u, d, None, t) for i, (x, y) in enumerate([("include", "include")] * 5 + [("exclude", "exclude")] * 3 + [("include", "exclude"), ("exclude", "include")]) for u, d in ((1, x), (2, y))]
    s = spark.createDataFrame([*rows, (1, 0, 1, "exclude", None, dt.datetime(2023, 1, 1)), (1, 99, 3, None, None, t)], "collection_id long, paper_id long, user_id long, decision string, note string, decided_at timestamp")
    now = screening.current(s)
    k = screening.cohen_kappa(now, least=1).first()
    assert (k.n, k.po, k.pe, k.kappa) == (10, 0.8, 0.52, 0.5833)
    assert screening.cohen_kappa(now).first().kappa is None
    same = now.withColumn("decision", F.lit("include"))
    assert screening.cohen_kappa(same, least=1).first().kappa is None
    assert screening.krippendorff_alpha(same, least=1).first().alpha is None
    assert {(r.paper_id, r.said) for r in screening.conflicts(now).collect()} == {(8, "exclude,include"), (9, "exclude,include")}


def test_bibtex(spark):
    p = papers(spark, paper(1, r"R&D_1 of DNA", authors=["Ann Lee"], venue="J"), paper(2, r"R&D_1 again", authors=["B Lee"]), paper(3, "x", authors=None, year=None))
    got = {r.id: (r.key, r.entry) for r in screening.bibtex_entries(p).collect()}
    assert got[1][0] == "lee2020rd1" and got[2][0] == "lee2020rd1a" and got[3][0] == "anonndx"
    assert got[1][1].startswith("@article{") and r"R\&D\_1 of {DNA}" in got[1][1] and "{DNA}" in got[1][1] and got[2][1].startswith("@misc{")


def test_latest_records_first_query(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    r = spark.createDataFrame([(1, "s", "x", "old", t[0], 7, None), (2, "s", "x", "new", t[2], 8, "q2"), (3, "s", "x", "mid", t[1], 9, "q1")], "id long, source string, source_id string, raw string, fetched_at timestamp, paper_id long, query_name string")
    row = rec.latest_records(r).first()
    assert (row.raw, row.query_name, row.fetches, row.id) == ("new", "q1", 3, 2)
    assert rec.latest_records(rec.latest_records(r).drop("fetches")).first().raw == "new"


def test_derived_papers(spark):
    raw = '{"display_name":"T","publication_year":2020,"abstract_inverted_index":{"b":[1],"a":[0,2]},"primary_location":null,"locations":[{"raw_source_name":"Raw"},{"source":{"display_name":"Venue"}}],"authorships":{"author":{"display_name":"A"}},"ids":{"pmid":"https://x/123"},"doi":"DOI:10.1/X"}'
    arxiv = '{"arxiv_id":"2001.1v3","title":"U","published":"2019-05-01T00:00:00Z","summary":" s ","authors":["B",null]}'
    r = spark.createDataFrame([(1, "openalex", "W", raw), (2, "arxiv", "x", arxiv)], "id long, source string, source_id string, raw string").select("*", F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(None).cast("long").alias("paper_id"), F.lit(None).cast("string").alias("query_name"))
    a, b = rec.derive_papers(r).orderBy("record_id").collect()
    assert (a.abstract, a.venue, a.authors, a.pubmed_id, a.doi, a.year) == ("a b a", "Venue", ["A"], "123", "10.1/x", 2020)
    assert (b.arxiv_id, b.year, b.abstract, b.authors, b.venue) == ("2001.1", 2019, "s", ["B"], None)


def test_xml_sources(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<feed><entry><id>http://x/abs/2001.1v2</id><title>T  t</title><summary>s</summary><published>2020-01-01</published><author><name>A</name></author><author><name>B</name></author></entry></feed>")
    (tmp_path / "p.xml").write_text('<set><article><pmid>1</pmid><title>T</title><abstract Label="AIM">x</abstract><abstract Label="END">y</abstract><year>2019 Jan</year><author><ForeName>A</ForeName><LastName>B</LastName></author><author><CollectiveName>G</CollectiveName></author><type>Retracted Publication</type></article></set>')
    a = rec.read_atom(spark, str(tmp_path / "a.xml")).first()
    assert (a.source_id, a.title, a.year, a.authors) == ("2001.1", "T t", 2020, ["A", "B"])
    p = rec.read_articles(spark, str(tmp_path / "p.xml")).first()
    assert (p.abstract, p.year, p.authors, p.is_retracted) == ("AIM: x END: y", 2019, ["A B", "G"], True)


def test_split_budget(spark):
    w = spark.createDataFrame([(i, 1.0) for i in range(3)], "idx int, weight double")
    assert [r.share for r in rec.split_budget(w, 10).orderBy("idx").collect()] == [4, 3, 3]


def test_fill_buckets():
    assert stats.fill_buckets([(1, 5, False), (2, 4, True), (3, 6, False), (4, 1, False)], 10) == [2, 1, 4]


def test_percentile_gate_and_recall(spark):
    s = spark.createDataFrame([("x", float(i)) for i in range(1, 21)], "g string, v double")
    got = {r.p: r.value for r in evaluation.percentiles(s, "v", ["g"], (0.5, 0.95)).collect()}
    assert got == {0.5: 10.0, 0.95: None}
    exact = spark.createDataFrame([(0, i, i, 1 - i / 10) for i in range(1, 5)], "query_id int, id long, rank int, score double")
    assert evaluation.recall_at_k(exact, exact, 4).first().recall == 1.0
    assert evaluation.recall_at_k(exact, exact.where("id <> 2"), 4).first().recall == 0.75


def test_wilson_and_kappa(spark):
    one = spark.range(1)
    w = one.select(evaluation.wilson(F.lit(0), F.lit(0)).alias("w"), evaluation.wilson(F.lit(8), F.lit(10)).alias("x")).first()
    assert tuple(w.w) == (0.0, 0.0) and tuple(w.x) == (0.4902, 0.9433)
    lab = spark.createDataFrame([(True, True)] * 5 + [(False, False)] * 5, "a boolean, b boolean")
    assert evaluation.binary_kappa(lab, "a", "b").first().kappa == 1.0


def test_even_sample(spark):
    p = spark.range(0, 100)
    ids = [r.id for r in stats.even_sample(p, 10).orderBy("id").collect()]
    assert ids == list(range(0, 100, 10))
    assert stats.even_sample(spark.range(5), 10).count() == 5


def test_bibtex_letters(spark):
    got = spark.createDataFrame([(i,) for i in (0, 25, 26, 701, 702)], "n int").select(screening.letters(F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == ["a", "z", "aa", "zz", "aaa"]


@pytest.mark.parametrize("name", ["boilerplate_seed", "source_overlap"])
def test_functions_exist(name):
    assert callable(getattr(pairs, name))


def test_ivf_recall_against_brute_force(spark, sf_dir):
    from paperloom.plans import catalog

    rows = catalog.ivf_recall(spark, sf_dir).collect()
    assert rows and sum(r.recall for r in rows) / len(rows) >= 0.9
    p = catalog.papers(spark, sf_dir)
    one = search.sound_vectors(p, catalog.DIM).orderBy("id").limit(1)
    batch = search.ivf_batch_topk(p, one, catalog.DIM, 20).orderBy("rank").collect()
    assert [r.id for r in batch] == [r.id for r in search.ivf_topk(p, list(one.first().embedding), 20).collect()]


def test_batch_goes_on_in_blocks(spark, sf_dir):
    from paperloom.plans import catalog

    p = catalog.papers(spark, sf_dir)
    q = search.sound_vectors(p, catalog.DIM).where("id % 20 = 0")
    order = lambda df: sorted((r.query_id, r.id, round(r.score, 9), r["rank"]) for r in df.collect())
    assert order(search.vector_batch_topk(p, q, catalog.DIM, 5, most=3)) == order(search.vector_batch_topk(p, q, catalog.DIM, 5))
    assert order(search.ivf_batch_topk(p, q, catalog.DIM, 5, most=3)) == order(search.ivf_batch_topk(p, q, catalog.DIM, 5))


def test_preprints_by_venue_and_record(spark):
    p = papers(spark, paper(1, "a", venue="bioRxiv"), paper(2, "b", venue="MedRxiv"), paper(3, "c", venue="Ward Letters"), paper(4, "d"), paper(5, "e", venue="Ward Letters"))
    records = spark.createDataFrame([("openalex", '{"results": [{"type": "article"}, {"type": "preprint"}]}', 5), ("pubmed", "{", 3), ("arxiv", None, None)], "source string, raw string, paper_id long")
    assert {r.id for r in pairs.preprints(p, records).collect()} == {1, 2, 5}
    assert {r.id: r.rank for r in groups.publication_rank(p, records).collect()} == {1: 0, 2: 0, 3: 2, 4: 1, 5: 0}


def test_fuzzy_floors_and_years(spark):
    t = "reading of ward notes by machines"
    p = papers(spark, paper(1, t, authors=["Li Xu"]), paper(2, t + "s", authors=["Bo Xu"]), paper(3, "short ward notes x"), paper(4, "short ward notes y"), paper(5, t, arxiv_id="1"), paper(6, t + "s"), paper(7, t, year=2021), paper(8, t, year=2022))
    assert pairs.title_trgm(p.where("id < 5")).count() == 0
    assert {(r.a, r.b) for r in pairs.preprint_trgm(p.where("id >= 5")).collect()} == {(5, 7)}


def test_boilerplate_abstracts_make_no_pairs(spark):
    p = papers(spark, *[paper(i, "a long title about screening", abstract="No text.") for i in (1, 2)], *[paper(i, "a long title about screening", abstract="w" * 60) for i in (3, 4)])
    assert {(r.a, r.b) for r in pairs.abstract_title(p, pairs.boilerplate_seed(p)).collect()} == {(3, 4)}


def test_hot_blocks_are_split_and_lose_nothing(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}") for i in range(90)]
    x, y = spark.createDataFrame(rows, "x long, k string"), spark.createDataFrame(rows, "y long, k string")
    got = [(r.x, r.y) for r in pairs.block_join(x, y, ["k"], "x", "y", hot=8).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, k in rows for b, m in rows if k == m}


def test_chain_report_takes_all_pairs(spark):
    p = papers(spark, *[paper(i, t) for i, t in enumerate(["abc", "abc", "abd", "zzz"])])
    m = spark.createDataFrame([(i, 0) for i in range(4)], "id long, root long")
    e = spark.createDataFrame([(0, 1, 1.0, "doi_exact"), (1, 2, 0.9, "title_trgm"), (2, 3, 0.9, "title_trgm")], "a long, b long, sim double, strategy string")
    r = groups.chain_report(e, m, p).first()
    assert (r.size, r.edges, r.density, r.min_sim) == (4, 3, 0.5, 0.0) and r.mean_sim == pytest.approx((1 + 2 * 2 / 6) / 6)


def test_kappa_is_by_collection(spark):
    rows = [(c, p, u, "include" if (p + c * u) % 2 else "exclude", dt.datetime(2024, 1, 1)) for c in (1, 2) for p in range(8) for u in (1, 2)]
    now = spark.createDataFrame(rows, "collection_id long, paper_id long, user_id long, decision string, decided_at timestamp")
    assert {r.collection_id: r.kappa for r in screening.cohen_kappa(now, least=1).collect()} == {1: -1.0, 2: 1.0}


def test_two_new_records_of_one_doi(spark):
    d = spark.createDataFrame([(1, "10.1/a"), (2, "10.1/a"), (3, None), (4, "10.1/b")], "record_id long, doi string")
    got = {r.record_id: (r.paper_id, r.new_record, r.outcome) for r in rec.create_or_link(d, papers(spark, paper(9, "t", doi="DOI:10.1/B"))).collect()}
    assert got == {1: (None, 1, "new"), 2: (None, 1, "linked"), 3: (None, 3, "new"), 4: (9, None, "linked")}


def test_every_work_of_a_page_is_read(spark):
    raws = ['{"results": [{"title": "One"}, {"title": "Two", "type": "erratum"}]}', '[{"title": "Three"}, null]', "null", "nope"]
    r = spark.createDataFrame([(i, "openalex", f"s{i}", x, dt.datetime(2024, 1, 1), None, None) for i, x in enumerate(raws)], "id long, source string, source_id string, raw string, fetched_at timestamp, paper_id long, query_name string")
    derived = rec.derive_papers(r)
    assert sorted(x.title for x in derived.collect()) == ["One", "Three", "Two"]
    assert sorted(x.title for x in rec.papers_only(derived).collect()) == ["One", "Three"]


@pytest.mark.parametrize("n,want", [(0, "a"), (25, "z"), (26, "aa"), (701, "zz"), (702, "aaa"), (18277, "zzz"), (18278, "aaaa"), (475254, "aaaaa")])
def test_letters(spark, n, want):
    assert spark.range(1).select(screening.letters(F.lit(n)).alias("s")).first().s == want


def test_text_moved(spark):
    p = papers(spark, paper(1, "a"), paper(2, "b", abstract="x"))
    merged = spark.createDataFrame([(1, "a", None), (2, "b", None)], "survivor long, title string, abstract string")
    assert [r.id for r in groups.text_moved(p, merged).collect()] == [2]


def test_blinding_and_rulings(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 1, 1, "include", at(1)), (1, 1, 2, "exclude", at(2)), (1, 2, 2, "maybe", at(3)), (2, 1, 2, "include", at(1))]
    now = spark.createDataFrame(rows, "collection_id long, paper_id long, user_id long, decision string, decided_at timestamp")
    c = spark.createDataFrame([(1, "blind", "screening"), (2, "open", "screening")], "id long, mode string, phase string")
    seen = lambda u: {(r.collection_id, r.paper_id, r.user_id) for r in screening.blinded_view(now, c, u).collect()}
    assert seen(1) == {(1, 1, 2), (2, 1, 2)} and seen(2) == {(1, 1, 1)} and seen(9) == {(2, 1, 2)}
    r = screening.reveal_preview(now).where("collection_id = 1").first()
    assert (r.papers, r.decisions, r.screeners, r.conflicts) == (2, 3, 2, 1)
    ruled = spark.createDataFrame([(1, 1, 2, at(2)), (1, 1, 2, at(1)), (1, 2, 1, at(9))], "collection_id long, paper_id long, resolved_by long, resolved_at timestamp")
    assert {(x.paper_id, x.self_resolved) for x in screening.self_resolved(ruled.where("paper_id = 2"), now).collect()} == {(2, False)}
    assert screening.self_resolved(ruled.limit(1), now).first().self_resolved is True


def test_buckets_means_and_intervals(spark):
    assert stats.fill_buckets([(1, 5, False), (2, 6, True), (3, 4, False)], 10) == [2, 3]
    with pytest.raises(ValueError):
        stats.fill_buckets([(1, 11, True)], 10)
    p = papers(spark, *[paper(i, "t", citation_count=i, year=2000 + (i == 4)) for i in range(1, 5)])
    got = {r.year: (r.n, r["mean"], r.stdev, r.error) for r in stats.mean_and_error(p, "citation_count", "year").collect()}
    assert got[2000] == (3, 2.0, 1.0, pytest.approx(3**-0.5)) and got[2001] == (1, 4.0, None, None)
    owned = spark.createDataFrame([("a", i) for i in range(1, 5)] + [("b", 1)], "q string, id long")
    assert {(r.q, r.id) for r in stats.proportional_subset(owned, p, "q", 4).collect()} == {("a", 4), ("a", 3), ("b", 1)}
    labels = spark.createDataFrame([("s", True, i % 5 > 0) for i in range(200)], "stratum string, merged boolean, same boolean")
    r = evaluation.bootstrap_precision(labels, spark.createDataFrame([("s", 1000)], "stratum string, population long")).first()
    assert 0.7 < r.low < 0.8 < r.high < 0.9


def test_cover_density_by_group_and_field(spark):
    p = papers(spark, paper(1, "alpha beta"), paper(2, "alpha", abstract="beta"), paper(3, "gamma x beta"), paper(4, "y", abstract="alpha beta"), paper(5, "alpha alpha"))
    got = {r.id: round(r.score, 6) for r in search.cover_density(p, "alpha OR gamma beta").collect()}
    assert got == {1: 0.5, 2: 0.0, 3: round(1 / 3, 6), 4: 0.2}
