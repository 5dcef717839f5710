from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.llm.survivorship import best_records, full_venues, merged_record

SCHEMA = "id long, venue string, abstract string, citation_count int, doi string, member long, size long, full string"
WHOLE = "We read all the notes. They were long and useful."


def row(i, venue=None, abstract=None, count=None, doi=None):
    return (i, venue, abstract, count, doi, 1, 1, "x")


def best(spark, rows, members):
    filler = [row(100 + i, "Journal of Ward Notes" if i < 6 else None, "We read the notes.") for i in range(60)]
    papers = spark.createDataFrame([*rows, *filler], SCHEMA)
    groups = spark.createDataFrame(members, "id long, group_id long")
    return papers, best_records(papers, groups)


def test_best_of_each_field(spark):
    rows = [
        row(1, "J Ward Not", WHOLE[:20] + "...", 2147483647, "10.5555/preprints.2020.1/v1"),
        row(2, "Journal of Ward Notes", "No abstract available.", 7, "doi:10.5555/jwn.2020.1"),
        row(3, "Preprint", WHOLE, 9, "10.5555/ 2020?.1"),
        row(4, "Journal of Ward Notes", WHOLE, 9, "10.5555/jwn.2020.1"),
        row(5, "n/a", "Wc read thc notes. Thc end.", -1, None),
    ]
    papers, got = best(spark, rows, [(i, 1) for i in range(1, 6)])
    assert {(r.field, r.paper_id) for r in got.collect()} == {("venue", 2), ("abstract", 3), ("citation_count", 3), ("doi", 2)}
    built = merged_record(papers, got).first()
    assert (built.venue, built.citation_count, built.abstract) == ("Journal of Ward Notes", 9, WHOLE)


def test_nothing_fit_and_nulls(spark):
    _, got = best(spark, [row(1), row(2, "", "", None, "")], [(1, 1), (2, 1), (50, 1)])
    assert got.count() == 0


def test_odd_words_are_no_damage(spark):
    said = ["H1N1 was found.", "The 1st group was read.", "An arc welding study.", "Once we ran the cat scan."]
    _, got = best(spark, [row(i, None, a) for i, a in enumerate(said)], [(i, i) for i in range(len(said))])
    assert sorted(r.paper_id for r in got.collect()) == [0, 1, 2, 3]


def test_trust_decides_between_equal_values(spark):
    rows = [row(1, "Journal of Ward Notes"), row(2, "Journal of Ward Notes"), row(3, "Journal of Ward Notes")]
    papers, _ = best(spark, rows, [])
    papers = papers.withColumns({"trust": F.when(F.col("id") > 1, 1), "at": -F.col("id")})
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, group_id long")
    assert [r.paper_id for r in best_records(papers, groups, priority=F.col("trust"), timestamp=F.col("at")).collect()] == [2]
    assert [r.paper_id for r in best_records(papers, groups, timestamp=-F.col("at")).collect()] == [3]


def test_large_groups_are_left_out_and_repeats_change_nothing(spark):
    rows = [row(i, None, None, i) for i in range(1, 12)]
    _, got = best(spark, rows, [(i, 1) for i in range(1, 10)] + [(10, 10), (11, 10)])
    assert [tuple(r) for r in got.collect()] == [(10, "citation_count", 11)]
    _, again = best(spark, rows + rows, [(10, 10), (11, 10)])
    assert [tuple(r) for r in again.collect()] == [(10, "citation_count", 11)]


def test_long_text_and_empty(spark):
    long = "Start. " + "word " * 20_000 + "end."
    _, got = best(spark, [row(1, None, WHOLE), row(2, None, long)], [(1, 1), (2, 1)])
    assert [tuple(r) for r in got.collect()] == [(1, "abstract", 2)]
    _, none = best(spark, [], [])
    assert none.count() == 0


def test_full_venues(spark):
    names = ["Annals of Screening Methods"] * 5 + ["Ann Screen Meth", "Annals of Screen..", "arXiv", "unknown", None, "ANN SCREEN METH.", "Annals of Screening Methods"]
    df = spark.createDataFrame([(n,) for n in names], "venue string")
    assert [r.venue for r in full_venues(df).collect()] == ["Annals of Screening Methods"]
