"""Languages of documents and of their segments, by a string kernel.

The kernel of two texts is the blended spectrum of character n-gram presence: the number
of 2- to 4-grams both hold, over the root of the product of their own numbers. A bounded
sample of labelled rows (``fit_rows``) is cut into segments; landmark segments, each the one
that those before it explain least, give the Nystrom features K(x, Z) L(Z, Z)^(-T), and
one-versus-rest kernel ridge regression on them gives one score per language. Labels err by
whole texts: a coarse fit finds the texts that speak for their label, two finer ones are made
from those. A softmax of the scores, its sharpness fitted on held-out segments, gives chances.

The decision is made over the document: the likeliest sequence of languages when every
change costs ``SWITCH``, so a single foreign sentence must make good two changes.

Because the kernel is linear in the presence vector, K(x, Z) times the regression's
coefficients folds into one table of weights per hashed n-gram; a batch of segments is
scored as one sparse matrix product with it. A document never leaves its row: cutting,
scoring and the decision happen in one pass without a shuffle. The sample, its order, the
landmarks and the held-out segments follow from hashes of the rows, so the result is the
same for any partitioning.

Defined results: a null, empty or wordless text has no segments and no language; a segment
below ``MIN_WORDS`` words goes with its neighbours; a label in another notation (code,
region, name) counts as the language it names, an unknown one as missing; equal scores go
to the earlier language of LANGUAGES; without any labelled row every text is of the first.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.session import spread

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl")

#: Notations of the seven languages besides their two-letter codes.
NOTATIONS = {
    "en": ("eng", "english", "englisch", "anglais", "ingles", "inglese"),
    "de": ("deu", "ger", "german", "deutsch", "allemand", "aleman", "tedesco"),
    "fr": ("fra", "fre", "french", "francais", "français", "franzosisch"),
    "es": ("spa", "spanish", "espanol", "español", "castellano", "spanisch"),
    "it": ("ita", "italian", "italiano", "italienisch"),
    "pt": ("por", "portuguese", "portugues", "português", "portugiesisch"),
    "nl": ("nld", "dut", "dutch", "nederlands", "flemish"),
}

BITS = 18
ORDERS = (2, 3, 4)
MIN_WORDS = 3
#: Log odds that a change of language must make good; one foreign sentence makes two changes.
SWITCH = 2.5
#: Segments whose distinct n-grams are found at once.
_ABREAST = 16

_TAG = re.compile(r"<[^<>]{1,400}>")
_NOISE = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\S+|\b10\.\d{4,9}/\S+|\\[a-zA-Z]+|[{}$#*_=|`~\[\]]+")
_BREAK = re.compile(r"[\r\n\v\f\x85  ]+|(?<=[.!?…;:])[\"'»”)\]]*\s+(?=[\"'«„“¿¡(\[]*[A-ZÀ-ÖØ-Þ])|\s+[–—|•·/]+\s+")
_WRAP = re.compile(r"(?<=[^\W\d_])[-\u00ad]\s*\r?\n\s*(?:>\s*)*(?=[^\W\d_A-ZÀ-ÖØ-Þ])")
_SOFT = re.compile(r"(?<=[^\s.!?:;])[ \t]*\r?\n[ \t]*(?:>[ \t]*)*(?=[a-zà-öø-ÿ0-9(])")
_WORD = re.compile(r"[^\W\d_]+")


def known_language(label: Column) -> Column:
    """The two-letter code a label means, null for none or an unknown one."""
    bare = F.lower(F.trim(label))
    base = F.regexp_extract(bare, r"^([\p{L}]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in NOTATIONS.items():
        out = F.when(base.isin(code, *names), code).otherwise(out)
    return out


def cut_segments(text: str | None) -> list[str]:
    """Sentences, headings and list items with at least one word; markup is taken away and wrapped lines are joined."""
    if not text:
        return []
    plain = unicodedata.normalize("NFKC", html.unescape(_TAG.sub("\n", text)))
    plain = _SOFT.sub(" ", _WRAP.sub("", plain))
    plain = _NOISE.sub(" ", plain)
    return [p.strip() for p in _BREAK.split(plain) if p and _WORD.search(p)]


def shape(segment: str) -> str:
    """The letters of a segment, lower case, words apart by one space: what the kernel sees."""
    return " " + " ".join(_WORD.findall(segment.lower())) + " "


def presence(shaped: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order the (segment, hashed n-gram) of every distinct n-gram of every segment, in order of segments."""
    if not shaped:
        return [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ORDERS]
    codes = np.frombuffer("".join(shaped).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(shaped)), [len(s) for s in shaped])
    last_seen = np.empty(_ABREAST << BITS, np.int32)  # never read before it is written
    out = []
    for n in ORDERS:
        h = np.full(max(0, len(codes) - n + 1), n * 0x51ED270B, np.uint64)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        of = owner[: len(h)][inside]
        gram = (h[inside] >> np.uint64(64 - BITS)).astype(np.int64)
        key = ((of % _ABREAST) << BITS) | gram
        place = np.arange(len(key), dtype=np.int32)
        once = np.empty(len(key), bool)
        bounds = np.searchsorted(of, np.arange(0, len(shaped) + _ABREAST, _ABREAST))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):  # so few segments at once that the table stays in cache
            last_seen[key[lo:hi]] = place[lo:hi]
            once[lo:hi] = last_seen[key[lo:hi]] == place[lo:hi]
        out.append((of[once], gram[once]))
    return out


@dataclass
class LanguageModel:
    weights: np.ndarray  # 2**BITS x languages
    sharpness: float  # of the softmax that turns scores into chances
    doubt: float  # chance that a segment is none of what its scores say

    def scores(self, shaped: list[str]) -> np.ndarray:
        """Regression scores, one row per segment."""
        out = np.zeros((len(shaped), len(LANGUAGES)), np.float32)
        count = np.zeros(len(shaped), np.int64)
        for owner, gram in presence(shaped):
            if len(owner):
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                out[owner[starts]] += np.add.reduceat(self.weights[gram], starts, axis=0)
                count += np.bincount(owner, minlength=len(shaped))
        return out / np.sqrt(np.maximum(1, count)).astype(np.float32)[:, None]

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """The calibrated chance of each language, one row per segment."""
        return _chances(scores, self.sharpness, self.doubt)


def _chances(scores: np.ndarray, sharpness: float, doubt: float) -> np.ndarray:
    z = np.exp(sharpness * (scores - scores.max(1, keepdims=True)))
    return (1 - doubt) * z / z.sum(1, keepdims=True) + doubt / scores.shape[1]


class _Kernel:
    """K(x, Z) = common n-grams / root of the product of their numbers, over a bounded set of segments."""

    def __init__(self, shaped: list[str]) -> None:
        parts = presence(shaped)
        owner, gram = np.concatenate([o for o, _ in parts]), np.concatenate([g for _, g in parts])
        order = np.argsort(owner, kind="stable")
        self.gram = gram[order]
        self.size = np.maximum(1, np.bincount(owner, minlength=len(shaped))).astype(np.float32)
        self.bounds = np.searchsorted(owner[order], np.arange(len(shaped) + 1))
        by_gram = np.argsort(gram, kind="stable")
        self.holder = owner[by_gram].astype(np.int32)
        self.held = np.searchsorted(gram[by_gram], np.arange((1 << BITS) + 1))
        self.root = np.sqrt(self.size)

    def grams(self, i: int) -> np.ndarray:
        return self.gram[self.bounds[i] : self.bounds[i + 1]]

    def column(self, i: int) -> np.ndarray:
        mine = self.grams(i)
        held = np.concatenate([self.holder[self.held[g] : self.held[g + 1]] for g in mine]) if len(mine) else np.empty(0, np.int32)
        return np.bincount(held, minlength=len(self.root)).astype(np.float32) / (self.root * self.root[i])


def nystrom(kernel: _Kernel, open_: np.ndarray, landmarks: int) -> tuple[np.ndarray, list[int]]:
    """(features, landmarks): at each step the open segment that the landmarks so far explain least becomes one.

    The features are the partial Cholesky factor of the kernel matrix, K(X, Z) L(Z, Z)^(-T).
    """
    rest = np.where(open_, 1.0, -1.0).astype(np.float32)
    features, chosen = np.zeros((len(rest), min(landmarks, int(open_.sum()))), np.float32), []
    for j in range(features.shape[1]):
        p = int(rest.argmax())
        if rest[p] < 1e-3:
            break
        column = (kernel.column(p) - features[:, :j] @ features[p, :j]) / np.sqrt(rest[p])
        features[:, j] = column
        rest -= column * column
        rest[p] = -1.0
        chosen.append(p)
    return features[:, : len(chosen)], chosen


def _order_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest())


def _ridge(kernel: _Kernel, y: np.ndarray, weight: np.ndarray, landmarks: int, ridge: float) -> np.ndarray:
    """Weights per hashed n-gram of the one-versus-rest regression on the segments of positive weight; each language weighs the same."""
    train = weight > 0
    phi, chosen = nystrom(kernel, train, landmarks)
    share = np.bincount(y[train], weight[train], minlength=len(LANGUAGES))
    w = (weight[train] / share[y[train]])[:, None]
    mine = phi[train]
    inner = (mine.T @ (mine * w.astype(np.float32))).astype(np.float64)
    beta = np.linalg.solve(inner + ridge / len(chosen) * np.eye(len(chosen)), mine.T @ (np.eye(len(LANGUAGES))[y[train]] * w))
    # K(x, Z) times the coefficients, as one weight per n-gram
    out = np.zeros((1 << BITS, len(LANGUAGES)), np.float32)
    for p, c in zip(chosen, np.linalg.solve(phi[chosen].astype(np.float64).T, beta), strict=True):
        out[kernel.grams(p)] += (c / kernel.root[p]).astype(np.float32)
    return out


def fit_language_model(texts: list[tuple[str, str]], landmarks: int = 1_100, max_segments: int = 6_300, ridge: float = 0.5) -> LanguageModel:
    """From (text, two-letter label) rows; each fit uses at most ``max_segments`` distinct segments of at most 400 characters.

    Labels err by whole texts. A first, coarse fit takes them as they are; after it only texts
    whose segments speak for their label count, and a segment that the fit holds for another
    language needs two such texts. Equal segments are one. The last fit takes the held-out
    segments in as well, under the curve found without them. Choice, landmarks and held-out segments follow from hashes, so the
    order of the rows changes nothing.
    """
    number: dict[str, int] = {}
    rows: list[tuple[np.ndarray, int]] = []  # the segments of each text, its label
    for text, lang in texts:
        own = [s for s in (shape(c) for c in cut_segments(text) if len(c) <= 400) if s.count(" ") > MIN_WORDS] if lang in LANGUAGES else []
        if own:
            rows.append((np.array([number.setdefault(s, len(number)) for s in own]), LANGUAGES.index(lang)))
    shaped = list(number)
    words = np.array([s.count(" ") - 1 for s in shaped])
    hashed = np.array([_order_of(s) for s in shaped], np.uint64)
    by_hash = np.argsort(hashed, kind="stable")
    held_out = (hashed >> np.uint64(7)) % np.uint64(5) == 0 if len(shaped) >= 40 else np.zeros(len(shaped), bool)
    model = LanguageModel(np.zeros((1 << BITS, len(LANGUAGES)), np.float32), 10.0, 0.5)
    clean, against = rows, np.zeros((len(shaped), len(LANGUAGES)))
    for last in (0, 1, 2):
        votes = against.copy()
        for own, k in clean:
            np.add.at(votes[:, k], own, 1.0)
        y, most = votes.argmax(1), votes.max(1)
        sure = (most > 0) & (most * 3 >= votes.sum(1) * 2)
        picked = np.concatenate([by_hash[(sure & (y == k))[by_hash]][: max(1, max_segments // len(LANGUAGES))] for k in range(len(LANGUAGES))])
        weight = np.sqrt(most[picked]) if last else most[picked]
        size, smooth = (landmarks, ridge) if last else (landmarks // 4, 10 * ridge)
        tested = picked[held_out[picked]]
        if len(tested) == len(picked):
            break
        kernel = _Kernel([shaped[i] for i in picked])
        folded = _ridge(kernel, y[picked], np.where(held_out[picked], 0.0, weight), size, smooth)
        curve = _calibrate(LanguageModel(folded, 10.0, 0.01), [shaped[i] for i in tested], y[tested])
        model = LanguageModel(_ridge(kernel, y[picked], weight, size, smooth) if last == 2 else folded, *curve)
        chances = model.chances(model.scores(shaped))
        decided = decide([words[own] for own, _ in rows], [chances[own] for own, _ in rows])
        clean, against = [], np.zeros((len(shaped), len(LANGUAGES)))
        for (own, k), of in zip(rows, decided, strict=True):
            if words[own][of == k].sum() * 2 > words[own].sum():
                clean.append((own, k))
                against[own[of != k], of[of != k]] = 1.0  # one objection, whatever the number of texts
    return model


def _calibrate(model: LanguageModel, shaped: list[str], y: np.ndarray) -> tuple[float, float]:
    """(sharpness, doubt) of greatest likelihood on held-out segments, whole and cut to their first and last halves and to four words."""
    if len(shaped) < 40:
        return 10.0, 0.01
    cut, of = [], []
    for s, k in zip(shaped, y, strict=True):
        w = s.split()
        for part in (w, w[: len(w) // 2 + 1], w[len(w) // 2 :], w[len(w) // 3 :][:4]):
            cut.append(" " + " ".join(part) + " ")
            of.append(k)
    scores, of = model.scores(cut), np.array(of)
    best = max(
        ((float(np.log(_chances(scores, a, d)[np.arange(len(of)), of]).sum()), -a, d) for a in np.geomspace(2, 60, 24) for d in (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1)),
    )
    return float(-best[1]), float(best[2])


def labelled_sample(documents: DataFrame, fit_rows: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most ``fit_rows`` distinct labelled texts of 20 to 20,000 characters, evenly over the languages, chosen and ordered by hash."""
    rows = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), known_language(F.col(lang_col)).alias("l")).where(
        F.col("l").isNotNull() & F.length("t").between(20, 20_000)
    )
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # seven rows
    each = max(1, fit_rows // len(LANGUAGES))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("l") == lang, int(min(1.0, (1.5 * each + 50) / n) * 1_000_000)).otherwise(share)
    few = rows.where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < share).select("l", "t").distinct().withColumn("h", F.xxhash64("t"))
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    picked = few.withColumn("at", first).where(F.col("at") <= each).collect()
    return sorted((r["t"], r["l"]) for r in picked)


def decide(words: list[np.ndarray], chances: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The language of each segment, document by document: the likeliest sequence when every change of language costs ``switch``.

    A segment below ``MIN_WORDS`` words says nothing by itself and goes with its neighbours.
    """
    sizes = np.array([len(w) for w in words])
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
    if not longest:
        return out
    starts = np.cumsum(np.r_[0, sizes])[:-1][order]
    gain = np.log(np.concatenate(chances))
    gain[np.concatenate(words) < MIN_WORDS] = 0.0
    n_langs = gain.shape[1]
    from_ = np.zeros((len(gain), n_langs), np.int8)
    total = np.zeros((len(words), n_langs))
    live = [int((sizes > p).sum()) for p in range(longest)]
    for p in range(longest):
        n = live[p]
        if p:
            top = total[:n].argmax(1)
            jump = np.take_along_axis(total[:n], top[:, None], 1) - switch
            stay = total[:n] >= jump
            from_[starts[:n] + p] = np.where(stay, np.arange(n_langs), top[:, None])
            total[:n] = np.maximum(total[:n], jump)
        total[:n] += gain[starts[:n] + p]
    at = np.zeros(len(words), np.int64)
    path = np.zeros(len(gain), np.int64)
    for p in range(longest - 1, -1, -1):
        n, ending = live[p], (live[p + 1] if p + 1 < longest else 0)
        at[ending:n] = total[ending:n].argmax(1)
        path[starts[:n] + p] = at[:n]
        at[:n] = from_[starts[:n] + p, at[:n]]
    for d in range(len(words)):
        k = order[d]
        out[k] = path[starts[d] : starts[d] + sizes[k]]
    return out


def _scored(documents: DataFrame, id_col: str, text_col: str, lang_col: str, fit_rows: int, rows_of, schema: str) -> DataFrame:
    """``rows_of`` (words, languages, confidences of a document's segments) as rows, beside the id and the label."""
    model = fit_language_model(labelled_sample(documents, fit_rows, id_col, text_col, lang_col))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    id_type = documents.schema[id_col].dataType.simpleString()
    source = documents.select(id_col, text_col, known_language(F.col(lang_col)).alias("label"))
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                cut = [[shape(s) for s in cut_segments(t)] for t in part.column(1).to_pylist()]
                number: dict[str, int] = {}  # equal segments are scored once
                at = [np.array([number.setdefault(s, len(number)) for s in segments], np.int64) for segments in cut]
                held = model.chances(model.scores(list(number))) if number else np.zeros((0, len(LANGUAGES)))
                chances = [held[a] for a in at]
                words = [np.array([s.count(" ") - 1 for s in segments], np.int64) for segments in cut]
                doc, out = [], []
                for d, (w, c, of) in enumerate(zip(words, chances, decide(words, chances), strict=True)):
                    if len(w):
                        rows = rows_of(w.tolist(), [LANGUAGES[k] for k in of], c[np.arange(len(w)), of].tolist())
                        doc += [d] * len(rows)
                        out += rows
                at = pa.array(doc, pa.int64())
                columns = list(zip(*out, strict=True)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)], part.column(2).take(at)],
                    names=[id_col, *names, "label"],
                )

    return spread(source).mapInArrow(run, f"`{id_col}` {id_type}, {schema}, label string")


def segment_languages(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 4_900
) -> DataFrame:
    """(id_col, segment, words, lang, confidence, label): one row per segment with words.

    ``label`` is the language that the row's own label means, null for none.
    """

    def rows_of(words: list[int], langs: list[str], sure: list[float]) -> list[tuple]:
        return [(i, *x) for i, x in enumerate(zip(words, langs, sure, strict=True))]

    return _scored(documents, id_col, text_col, lang_col, fit_rows, rows_of, "segment int, words int, lang string, confidence double")


def document_languages(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 4_900
) -> DataFrame:
    """(id_col, languages, lang, words, confidence, label): one row per document and language of its text."""

    def rows_of(words: list[int], langs: list[str], sure: list[float]) -> list[tuple]:
        total: dict[str, list] = {}
        for n, lang, c in zip(words, langs, sure, strict=True):
            held = total.setdefault(lang, [0, 0.0])
            held[0] += n
            held[1] = max(held[1], c)
        return [(len(total), lang, n, c) for lang, (n, c) in total.items()]

    return _scored(documents, id_col, text_col, lang_col, fit_rows, rows_of, "languages int, lang string, words int, confidence double")


def mislabelled(found: DataFrame) -> DataFrame:
    """The rows of documents whose label is missing or wrong, or whose text has several languages."""
    return found.where((F.col("languages") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang")))
