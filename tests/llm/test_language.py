from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm.language import cut_segments, decide, document_languages, fit_language_model, known_language, mislabelled, presence, segment_languages, shape

SAID = {
    "en": "the old house near the river was sold because nobody wanted to live there after the long winter and the children had left",
    "de": "das alte haus am fluss wurde verkauft weil nach dem langen winter niemand mehr dort wohnen wollte und die kinder gegangen waren",
    "fr": "la vieille maison pres de la riviere a ete vendue parce que personne ne voulait y vivre apres le long hiver avec ses enfants",
    "es": "la casa vieja cerca del rio fue vendida porque nadie queria vivir alli despues del largo invierno y los hijos se habian ido",
    "it": "la vecchia casa vicino al fiume fu venduta perche nessuno voleva viverci dopo il lungo inverno e i figli erano partiti",
    "pt": "a casa velha perto do rio foi vendida porque ninguem queria morar ali depois do longo inverno e os filhos tinham partido",
    "nl": "het oude huis bij de rivier werd verkocht omdat niemand er na de lange winter nog wilde wonen en de kinderen waren vertrokken",
}


def sentence(lang, rng, n=9):
    words = SAID[lang].split()
    at = rng.randrange(len(words) - n)
    return " ".join(words[at : at + n]).capitalize() + "."


def corpus(rng, per=40):
    return [(" ".join(sentence(k, rng) for _ in range(4)), k if rng.random() > 0.05 else rng.choice(list(SAID))) for k in SAID for _ in range(per)]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(2)
    rows = [(i, t, k) for i, (t, k) in enumerate(corpus(rng))]
    rows += [(1000, sentence("de", rng) + " " + sentence("de", rng), "en"), (1001, sentence("fr", rng) + "\n" + sentence("fr", rng), "French"), (1002, sentence("it", rng) + " " + sentence("nl", rng), "it")]
    rows += [(1003, None, None), (1004, "", "en"), (1005, "12 + 3 = 15", None), (1006, " ".join(sentence("es", rng) for _ in range(900)), None), (1006, "x", "und")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, words int")
    return df, mislabelled(document_languages(df)).collect()


def test_wrong_missing_and_mixed(found):
    got = {}
    for r in found[1]:
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert got[1000] == {"de"} and 1001 not in got and got[1002] == {"it", "nl"} and "es" in got[1006]
    assert not {1003, 1004, 1005} & set(got)


def test_held_out_accuracy():
    rng = random.Random(3)
    model = fit_language_model(corpus(rng))
    test = [(sentence(k, random.Random(9 + i), 6), k) for k in SAID for i in range(20)]
    scores = model.scores([shape(s) for s, _ in test])
    assert (scores.argmax(1) == [list(SAID).index(k) for _, k in test]).mean() > 0.95
    chances = model.chances(scores)
    assert np.allclose(chances.sum(1), 1) and chances.min() > 0


def test_presence_equals_sets():
    said = [shape(s) for s in ("Banana na", "a", "xx  xx", "banana na", "äöü ß" * 30)] * 9
    got = {}
    for (owner, gram), n in zip(presence(said), (2, 3, 4), strict=True):
        assert (np.diff(owner) >= 0).all()
        for i, s in enumerate(said):
            got[i, n] = sorted(gram[owner == i])
            assert len(got[i, n]) == len({s[j : j + n] for j in range(len(s) - n + 1)})
    assert got[0, 3] == got[3, 3]


def test_sequence_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        words = [rng.integers(1, 9, n) for n in (0, 1, 4, 2)]
        chances = [rng.dirichlet([0.3] * 3, len(w)) + 1e-6 for w in words]
        for w, c, got in zip(words, chances, decide(words, chances, 1.2), strict=True):
            def worth(path, w=w, c=c):
                return sum(np.log(c[i, k]) for i, k in enumerate(path) if w[i] >= 3) - 1.2 * sum(x != y for x, y in zip(path, path[1:], strict=False))
            best = max((worth(p) for p in itertools.product(range(3), repeat=len(w))), default=0.0)
            assert len(got) == len(w) and abs(worth(list(got)) - best) < 1e-9


def test_same_rows_for_any_partitioning(spark, found):
    want = sorted((r.doc_id, r.lang) for r in found[1])
    for other in (found[0].repartition(3), found[0].repartition(5, "doc_id"), found[0].coalesce(1).orderBy(F.desc("doc_id"))):
        assert sorted((r.doc_id, r.lang) for r in mislabelled(document_languages(other)).collect()) == want


def test_segments(spark, found):
    rows = segment_languages(found[0].where("doc_id = 1002"), fit_rows=10).collect()
    assert [r.segment for r in rows] == [0, 1]
    assert cut_segments("<p>One here.</p> Two there / Three.\n\n4 5\n\nWrapped li-\nne goes on") == ["One here.", "Two there", "Three.", "Wrapped line goes on"]
    assert cut_segments(None) == [] and cut_segments("  \t") == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert document_languages(df).count() == 0


def test_notations(spark):
    said = ["en", "EN", "en-GB", "en_us", "English", "ger", "deu", "Deutsch", "fra", "pt-BR", "nld", "", None, "und", "xx"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(known_language(F.col("s")).alias("k")).collect()
    assert [r.k for r in got] == ["en"] * 5 + ["de"] * 3 + ["fr", "pt", "nl", None, None, None, None]
