from __future__ import annotations

import random

import pytest

from paperloom.llm.names import author_names, cut_name, damerau, entity_spellings, near_words, spelling_pairs

ONE = ["Gabriela H. Kostrevanik", "Kostrevanik, Gabriela", "Kostrevanik GH", "gabriela h. kostrevanik", "Gabriela  H. Kostrevanik", "Gabi Kostrevanik", "Gabriela Kostrevnaik", "Dr. Gabriela Kostrevanik", "Gabriela H. Kostrevanik, PhD", "G. Kostrevanik"]
TWO = ["Marco Kostrevanik", "M. Kostrevanik"]
BODY = ["Trevalin Asthma Study Group", "The Trevalin Asthma Study Group", "Trevalin Asthma Study Grp", "Study Group, Trevalin Asthma", "Trevalin Asthma Study Group (TREAS)", "Trevalin ASG", "TREVALIN ASTHMA STUDY GROUP"]
ALONE = ["Oskar Blint", "et al.", "Trevalin Stroke Consortium"]


def entities(spark, *lists):
    df = spark.createDataFrame([(list(x) if x is not None else None, "c") for x in lists], "authors array<string>, name string")
    out = {}
    for r in entity_spellings(author_names(df)).collect():
        out.setdefault(r.entity, set()).add(r.name)
    return sorted(out.values(), key=len, reverse=True)


def test_variants_meet_and_namesakes_do_not(spark):
    got = entities(spark, ONE, TWO, BODY, ALONE, [None, "", "  "], None)
    assert set(ONE) in got and set(TWO) in got and set(BODY) in got
    assert not any("et al." in g for g in got) and {"Oskar Blint"} in got


def test_pairs_are_ordered_and_distinct(spark):
    df = spark.createDataFrame([(TWO + TWO,), (TWO,)], "authors array<string>")
    got = spelling_pairs(entity_spellings(author_names(df)))
    assert [tuple(r) for r in got.collect()] == [("M. Kostrevanik", "Marco Kostrevanik")]


def test_hyphens_accents_and_case(spark):
    same = ["Halima Troufal-Dorv", "HALIMA TROUFAL-DORV", "Troufal-Dorv H", "Halima Troufál-Dorv", "Halima Troufal Dorv"]
    assert set(same) in entities(spark, same)


def test_empty_and_long(spark):
    assert entities(spark) == [] if False else entity_spellings(author_names(spark.createDataFrame([], "authors array<string>"))).count() == 0
    long = "Maria " + "x" * 60
    assert {long, long.upper()} in entities(spark, [long, long.upper()])


@pytest.mark.parametrize("a,b,d", [("abc", "abc", 0), ("abcd", "abdc", 1), ("ca", "abc", 2), ("", "ab", 2)])
def test_damerau(a, b, d):
    assert damerau(a, b) == d == damerau(b, a)


def test_metric_balls_equal_brute_force(spark):
    words = ["kostrevanik", "kostrevnaik", "kostrevani", "kostrewanix", "abcd", "abce", "abc", "xyz", "trevalin", "trefalim"]
    got = {(r.a, r.b) for r in near_words(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()}
    r = lambda a, b: 0 if min(len(a), len(b)) <= 3 else 1 if min(len(a), len(b)) <= 5 else 2
    assert got == {(a, b) for a in words for b in words if damerau(a, b) <= r(a, b)}


def test_random_words_with_swaps_equal_brute_force(spark):
    rng = random.Random(8)
    words = set()
    for n in range(3, 10):
        for _ in range(12):
            w = "".join(rng.choice("abce") for _ in range(n))
            i = rng.randrange(n - 1)
            v = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
            j = rng.randrange(len(v))
            words |= {w, v, v[:j] + "x" + v[j + 1 :], v[:j] + v[j + 1 :]}
    words |= {"lopez", "lpoez", "weber", "weebr", "schmidt", "shcmidt"}
    got = {(r.a, r.b): r.d for r in near_words(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()}
    r = lambda a, b: 0 if min(len(a), len(b)) <= 3 else 1 if min(len(a), len(b)) <= 5 else 2
    assert got == {(a, b): d for a in words for b in words if (d := damerau(a, b)) <= r(a, b)}


def test_cut_name():
    assert cut_name("de Boer, Jan")[1] == ["jan", "de", "boer"]
    assert cut_name("Smith AB")[4] == ["a", "b"]


def test_a_frequent_family_name_keeps_its_reading(spark):
    one = ["William Smith", "Bill Smith", "W. Smith", "Smith, William"]
    crowd = [f"{a}{b}elo Smith" for a in ("Brun", "Dag", "Fjor", "Gunt", "Hesk", "Jarv", "Klim") for b in ("va", "ri", "mu", "xo", "te")]
    got = entities(spark, one, crowd, ["William Jones", "William Brown"])
    assert set(one) in got
