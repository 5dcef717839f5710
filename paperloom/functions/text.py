"""Column functions on titles, identifiers and abstracts; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Resolver prefixes taken off a DOI, in this order.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi.org/", "doi:")
#: Fixed value: what marks the title of a part (a figure, a supplement) of another work.
PART_PREFIX = (
    "^(additional file|additional table|additional figure|supplementary|supplemental"
    "|supporting information|appendix|figure s?[0-9]|table s?[0-9]|data (from|for)"
    "|dataset for|multimedia appendix)"
)
#: Fixed value: titles in the length band differ by at most this share of the shorter, plus two.
LENGTH_BAND = 0.1765
#: Words the analyzer leaves out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "to", "was", "were", "with")


def normalize_doi(doi: Column) -> Column:
    """Trimmed, lower case, without a resolver prefix; empty is null."""
    out = F.lower(F.regexp_replace(doi, r"^\s+|\s+$", ""))
    for p in DOI_PREFIXES:
        out = F.when(F.startswith(out, F.lit(p)), F.substring(out, F.lit(len(p) + 1), F.length(out))).otherwise(out)
    return F.nullif(out, F.lit(""))


def normalize_title(title: Column) -> Column:
    """Lower case, punctuation to spaces, spaces collapsed, a leading "the " dropped."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    return F.regexp_replace(plain, "^the ", "")


def tokens(text: Column, drop: tuple[str, ...] = STOP_WORDS) -> Column:
    """The words of a text in order, without stop words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*drop))


#: Fixed value: what the encoder expects before a query, but not before a document.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def query_text(query: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), query)


def token_hash(token: Column) -> Column:
    """The form in which a secret token is kept."""
    return F.sha2(token, 256)


def trigrams(text: Column) -> Column:
    """The set of 3-grams of a text's words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two sets; two empty sets give 0."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def in_length_band(a: Column, b: Column) -> Column:
    short = F.least(F.length(a), F.length(b))
    return F.abs(F.length(a) - F.length(b)) <= F.ceil(short * LENGTH_BAND) + 2


def masked_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "#")


def enum_siblings(a: Column, b: Column) -> Column:
    """The titles differ, and only in numbers."""
    return (a != b) & (masked_digits(a) == masked_digits(b))


def part_siblings(a: Column, b: Column) -> Column:
    """The titles differ, and one names a part of a work."""
    return (a != b) & (a.rlike(PART_PREFIX) | b.rlike(PART_PREFIX))


def siblings(a: Column, b: Column) -> Column:
    return enum_siblings(a, b) | part_siblings(a, b)


def document_text(title: Column, abstract: Column) -> Column:
    """What an encoder reads: "title. abstract", or the title alone."""
    return F.when(F.coalesce(F.length(F.trim(abstract)), F.lit(0)) > 0, F.concat(title, F.lit(". "), abstract)).otherwise(title)


def invert_text(text: Column) -> Column:
    """{word: positions} of a text's space-separated words."""
    words = F.split(text, " ")
    return F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("word"), F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == w).alias("positions")))


def deinvert(entries: Column) -> Column:
    """The text of an inverted index given as (word, positions) entries: by position, then word; none is null."""
    placed = F.flatten(F.transform(entries, lambda e: F.transform(e["positions"], lambda p: F.struct(p.alias("at"), e["word"].alias("word")))))
    text = F.array_join(F.transform(F.array_sort(placed), lambda x: x["word"]), " ")
    return F.when(F.size(entries) > 0, text)


def csv_cell(text: Column) -> Column:
    """A cell no spreadsheet runs as a formula; null is empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))
