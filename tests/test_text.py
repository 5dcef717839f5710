from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as ft


def value(spark, column, **named):
    row = spark.createDataFrame([tuple(named.values())], ", ".join(f"{k} string" for k in named))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("raw,want", [("HTTPS://DOI.ORG/10.77/Ward.Q", "10.77/ward.q"), ("http://doi.org/10.77/a", "10.77/a"), ("doi.org/10.77/b", "10.77/b"), ("https://doi.org/doi:10.77/c", "10.77/c"), ("\t", None), (None, None)])
def test_normalize_doi(spark, raw, want):
    assert value(spark, ft.normalize_doi(F.col("x")), x=raw) == want


@pytest.mark.parametrize(
    "raw,want",
    [("The  Ward-Round (2nd) notes.", "ward round 2nd notes"), ("Theatre logs", "theatre logs"), ("the", "the"), ("Größe & Wert_1", "größe wert_1"), (None, None)],
)
def test_normalize_title(spark, raw, want):
    assert value(spark, ft.normalize_title(F.col("x")), x=raw) == want


def test_trigram_similarity(spark):
    sim = ft.trigram_similarity(F.col("a"), F.col("b"))
    assert value(spark, sim, a="word", b="two words") == pytest.approx(4 / 11)
    assert value(spark, sim, a="", b="") == 0.0
    assert value(spark, sim, a="same", b="same") == 1.0


def test_siblings(spark):
    enum, part = ft.enum_siblings(F.col("a"), F.col("b")), ft.part_siblings(F.col("a"), F.col("b"))
    assert value(spark, enum, a="file 1 of x", b="file 3 of x") is True
    assert value(spark, enum, a="same", b="same") is False
    assert value(spark, part, a="additional file 2 of x", b="x") is True
    assert value(spark, part, a="additional file 2 of x", b="additional file 2 of x") is False


def test_invert_and_back(spark):
    assert value(spark, ft.deinvert(ft.invert_text(F.col("x"))), x="a b a  c") == "a b a  c"


def test_csv_cell(spark):
    assert value(spark, ft.csv_cell(F.col("x")), x="=1+1") == "'=1+1"
    assert value(spark, ft.csv_cell(F.col("x")), x=None) == ""
    assert value(spark, ft.csv_cell(F.col("x")), x="plain") == "plain"


def test_document_text(spark):
    out = ft.document_text(F.col("t"), F.col("a"))
    assert value(spark, out, t="T", a="A") == "T. A"
    assert value(spark, out, t="T", a=None) == "T"
    assert value(spark, out, t="T", a="  ") == "T"
