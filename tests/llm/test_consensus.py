from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from paperloom.llm import consensus
from paperloom.llm.consensus import current_labels, digamma, fit_consensus, log_gamma, krippendorff, normal_decision

SCHEMA = "collection_id long, paper_id long, user_id long, decision string, decided_at timestamp_ntz, y string, u long"
T = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)


def test_recovers_hidden_classes(spark):
    rng = random.Random(3)
    names, rows, truth = ["include", "exclude", "maybe"], [], {}
    for p in range(400):
        k = rng.choices(range(3), [3, 5, 2])[0]
        truth[p] = names[k]
        for u in range(7):
            if u < 3:
                said = k if rng.random() < 0.9 else rng.randrange(3)
            elif u < 5:
                said = (k + 1) % 3 if rng.random() < 0.85 else rng.randrange(3)  # wrong in a steady way
            else:
                said = rng.randrange(3)
            if rng.random() < 0.7:
                rows.append((1, p, u, names[said], T))
    fit = fit_consensus(current_labels(frame(spark, rows)))
    got = {r.p: r.decision for r in fit.items.collect()}
    assert sum(got[p] == truth[p] for p in got) / len(got) > 0.9
    trust = {r.u: (r.low, r.reliability, r.high) for r in fit.annotators.collect()}
    assert trust[0][1] > 0.8 and trust[3][1] < 0.35 and all(a <= b <= c for a, b, c in trust.values())


def test_current_label(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 1, 1, "include", day(1)), (1, 1, 1, " Excluded", day(2)), (1, 1, 1, " Excluded", day(2)), (1, 1, 2, "include", day(1)), (1, 1, 2, "-", day(3)), (None, 1, 1, "include", T), (1, 2, 1, None, None), (1, 3, 1, "maybe?", None)]
    assert {tuple(r) for r in current_labels(frame(spark, rows)).collect()} == {(1, 1, 1, 1), (1, 3, 1, 2)}


def test_few_raters_and_empty(spark):
    rows = [(1, 1, u, "include", T) for u in range(3)] + [(1, 2, u, "exclude", T) for u in range(2)]
    assert [(r.p, r.decision) for r in fit_consensus(current_labels(frame(spark, rows))).items.collect()] == [(1, "include")]
    none = fit_consensus(current_labels(frame(spark, [])))
    assert none.items.count() == 0 and none.annotators.count() == 0


def test_spellings(spark):
    said = ["include", "INCLUDE ", "incl.", "included", "exclude", "excl.", "maybe?", "unsure", "", "-", None, "other"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(normal_decision(F.col("s")).alias("k")).collect()
    assert [r.k for r in got] == [0, 0, 0, 0, 1, 1, 2, 2, None, None, None, None]


@pytest.mark.parametrize("x,want", [(1.0, -0.5772156649), (0.5, -1.9635100260), (10.0, 2.2517525890)])
def test_digamma(spark, x, want):
    assert spark.range(1).select(digamma(F.lit(x)).alias("v")).first().v == pytest.approx(want, abs=1e-8)


def test_krippendorff(spark):
    rows = [(1, p, u, d, T) for p, ds in enumerate([("include", "include"), ("exclude", "exclude"), ("include", "exclude")]) for u, d in enumerate(ds)]
    got = krippendorff(current_labels(frame(spark, rows))).first()
    assert (got.items, got["values"]) == (3, 6) and got.alpha == pytest.approx(1 - (2 / 6) / (18 / 30))


@pytest.mark.parametrize("x", [0.3, 1.0, 2.5, 40.0, 1e5])
def test_log_gamma(spark, x):
    assert spark.range(1).select(log_gamma(F.lit(x)).alias("v")).first().v == pytest.approx(math.lgamma(x), abs=1e-8, rel=1e-12)


def test_a_cut_off_fit_says_so(spark):
    rows = [(1, p, u, "include" if (p * u) % 3 else "exclude", T) for p in range(30) for u in range(4)]
    with pytest.warns(RuntimeWarning):
        assert not fit_consensus(current_labels(frame(spark, rows)), max_rounds=1).converged
    assert fit_consensus(current_labels(frame(spark, rows))).converged


def test_tables_beyond_the_driver_limit_give_the_same(spark, monkeypatch):
    rows = [(p % 2, p, u, "include" if (p * u) % 3 else "exclude", T) for p in range(40) for u in range(5)]
    few = fit_consensus(current_labels(frame(spark, rows)))
    monkeypatch.setattr(consensus, "DRIVER_ROWS", 2)
    many = fit_consensus(current_labels(frame(spark, rows)))
    assert few.rounds == many.rounds and sorted(few.items.collect()) == sorted(many.items.collect())
