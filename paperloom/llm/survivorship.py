"""Field-by-field survivorship: the best record of a group for each attribute.

One aggregation per run takes, for every attribute, the maximum of a composite struct
whose fields rank the candidates: null unless fit, then the attribute's own measure of
quality, then the source's priority and the record's time where they are given, then the
smaller record id. Nothing is collected per group.

What makes a value fit:

* venue - the full name of a place of publication. Stand-ins (blank, "unknown",
  preprint servers, import remarks), cut names and abbreviations are unfit. A word is an
  abbreviation when, over all venues of the table, a longer word that it begins is at
  least ``ABBREVIATION_RATIO`` times as frequent; that lexicon is computed from whole
  tables by grouping distinct names first, so a dominant venue is one row.
* abstract - the whole text and nothing else: no mark of cutting at either end or of wrong
  decoding, no markup, no page furniture, not read wrongly by a character recognition (at
  least ``MISREAD_WORDS`` different words that the corpus's own word counts show to be
  misreadings); the longest fit one.
* citation_count - the highest that is not a sentinel.
* doi - syntactically sound and not a preprint's; a resolver or "doi:" prefix does no harm.

Defined results: a field without a fit value gives no row for that group; equal values
go to the smallest record id; records missing from the table only count for the group's
size; repeated rows change nothing; null ids are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABBREVIATION_RATIO = 2.0
MAX_CREDIBLE_COUNT = 900_000

#: Fixed patterns of values that stand in for a venue.
STAND_IN = (
    r"(?i)^\W*(n/?a|none|null|nan|unknown|untitled|not (given|available|specified|known))?\W*$"
    r"|preprint|arxiv|biorxiv|medrxiv|research square|\bssrn\b|draft|peer.reviewed|^imported |title not given"
)
#: Fixed phrases of web pages and catalogues that stand in or beside an abstract.
FURNITURE = (
    r"(?i)no abstract available|^\W*see the full text\W*$|^\W*\[?abstract\]?\W*$|this record is provided for information|terms of the publisher|"
    r"home browse journals|you are here:|advanced search|cookies are needed|terms of use|all rights are reserved"
)
#: Fixed traces of wrong decoding and of markup.
BROKEN = r"�|Ã.|Â.|â€|<[a-zA-Z/][^>]*>|&[a-z]+;|&#\d+;"
#: Shapes that character recognition takes for others (read, meant).
MISREAD = (("c", "e"), ("rn", "m"), ("0", "o"), ("1", "l"), ("1", "i"), ("cl", "d"), ("vv", "w"))
#: A word is a misreading when a word it is a misreading of stands in so many times as many abstracts, ...
MISREAD_RATIO = 20
#: ... and an abstract is damaged by so many different ones.
MISREAD_WORDS = 2
MISREAD_SHAPES = 3
CUT_END = r"(\.\.|…|\[truncated\]|\(more\))\s*$"
WHOLE = r"(?s)^\s*[\p{Lu}\"'(\[].*[.!?][\"')\]]*\s*$"
DOI_PREFIX = r"(?i)^\s*(https?://)?(dx\.)?(doi\.org/|doi:\s*)"
FUNCTION_WORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "the", "to", "with")


def venue_words(venue: Column) -> Column:
    return F.filter(F.split(F.lower(venue), r"[^\p{L}]+"), lambda w: (F.length(w) > 0) & ~w.isin(*FUNCTION_WORDS))


def full_venues(papers: DataFrame) -> DataFrame:
    """(venue) of every distinct full name in the table."""
    names = papers.where(F.col("venue").isNotNull()).groupBy("venue").agg(F.count(F.lit(1)).alias("n"))
    names = names.where(~F.col("venue").rlike(STAND_IN) & ~F.col("venue").rlike(CUT_END) & ~F.col("venue").contains("|"))
    words = names.select("n", F.explode(F.array_distinct(venue_words(F.col("venue")))).alias("w")).groupBy("w").agg(F.sum("n").alias("n"))
    begun = words.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("w") - 1)), lambda i: F.substring(F.col("w"), F.lit(1), i))).alias("p"),
        "w", "n",
    ).where(F.col("p") != F.col("w"))
    longer = begun.groupBy("p").agg(F.max("n").alias("longer"))
    short = words.join(longer, words["w"] == longer["p"]).where(F.col("longer") >= ABBREVIATION_RATIO * F.col("n")).select("w")
    abbreviated = names.select("venue", F.explode(venue_words(F.col("venue"))).alias("w")).join(short, "w", "left_semi").select("venue").distinct()
    return names.join(abbreviated, "venue", "left_anti").select("venue")


def fit_abstract(a: Column) -> Column:
    return a.isNotNull() & a.rlike(WHOLE) & ~a.rlike(CUT_END) & ~a.rlike(BROKEN) & ~a.rlike(FURNITURE)


def _words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w != "")


def _meant(words: Column) -> Column:
    """``words`` and every word that one of them is with one shape taken for another."""
    shapes = [F.flatten(F.transform(words, lambda w: _corrected(w, read, meant))) for read, meant in MISREAD]  # noqa: B023
    return F.array_distinct(F.concat(words, *shapes))


def _corrected(word: Column, read: str, meant: str) -> Column:
    """``word`` with ``meant`` in place of each ``read`` in turn."""
    n = len(read)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word))), lambda i: F.substring(word, i, F.lit(n)) == read)
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit(meant), F.substring(word, i + n, F.length(word))))


def misread_words(papers: DataFrame) -> DataFrame:
    """(w): the words of abstracts that are misreadings, in up to ``MISREAD_SHAPES`` shapes, of much more frequent ones."""
    counts = papers.select(F.explode(_words(F.col("abstract"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    open_ = counts.where(F.col("w").rlike("|".join(sorted({read for read, _ in MISREAD}))) & (F.length("w") <= 40))
    meant = open_.withColumn("u", F.col("w"))
    for _ in range(MISREAD_SHAPES):
        meant = meant.select("w", "n", F.explode(_meant(F.array("u"))).alias("u")).distinct()
    frequent = counts.select(F.col("w").alias("u"), F.col("n").alias("often"))
    return meant.where("u <> w").join(frequent, "u").where(F.col("often") >= MISREAD_RATIO * F.col("n")).select("w").distinct()


def damaged_abstracts(papers: DataFrame, misread: DataFrame) -> DataFrame:
    """(id) of the records whose abstract holds ``MISREAD_WORDS`` different misreadings."""
    shape = "|".join(sorted({read for read, _ in MISREAD}))
    held = papers.select("id", F.explode(F.filter(_words(F.col("abstract")), lambda w: w.rlike(shape))).alias("w"))
    return held.join(misread, "w", "left_semi").groupBy("id").agg(F.count_distinct("w").alias("n")).where(F.col("n") >= MISREAD_WORDS).select("id")


def credible_count(n: Column) -> Column:
    return (n >= 0) & (n < MAX_CREDIBLE_COUNT)


def bare_doi(doi: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(doi, DOI_PREFIX, "")))


def published_doi(doi: Column) -> Column:
    d = bare_doi(doi)
    return d.rlike(r"^10\.[0-9]{4,9}/[^\s?<>\"]+$") & ~d.rlike(r"preprint|arxiv|/v[0-9]+$|unassigned")


def best_records(papers: DataFrame, groups: DataFrame, max_size: int = 8, priority: Column | None = None, timestamp: Column | None = None) -> DataFrame:
    """(group_id, field, paper_id) for the groups of at most ``max_size`` records.

    Of equally good values the one of higher ``priority``, then of later ``timestamp`` wins (null last), then the smallest id.
    """
    small = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= max_size).select("group_id")
    members = groups.join(small, "group_id").select(F.col("id").alias("member"), "group_id")
    trust = [c for c in (priority, timestamp) if c is not None]
    fields = papers.select("id", "venue", "abstract", "citation_count", "doi", *[c.alias(f"trust{i}") for i, c in enumerate(trust)])
    named = full_venues(papers).withColumn("full", F.lit(True))
    held = fields.join(members, fields["id"] == members["member"]).drop("member")
    damaged = damaged_abstracts(held.select("id", "abstract"), misread_words(papers)).withColumn("damaged", F.lit(True))
    held = held.join(named, "venue", "left").join(damaged, "id", "left")

    def ranked(fit: Column, *quality: Column) -> Column:
        by = [*quality, *[F.col(f"trust{i}") for i in range(len(trust))]]
        return F.max(F.when(F.coalesce(fit, F.lit(False)), F.struct(*[q.alias(f"q{i}") for i, q in enumerate(by)], (-F.col("id")).alias("low"))))

    best = held.groupBy("group_id").agg(
        ranked(F.col("full"), F.lit(1)).alias("venue"),
        ranked(fit_abstract(F.col("abstract")) & F.col("damaged").isNull(), F.length(F.trim("abstract"))).alias("abstract"),
        ranked(credible_count(F.col("citation_count")), F.col("citation_count")).alias("citation_count"),
        ranked(published_doi(F.col("doi")), F.lit(1)).alias("doi"),
    )
    winner = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (-F.col(f)["low"]).alias("paper_id")) for f in ("venue", "abstract", "citation_count", "doi")]))
    return best.select("group_id", winner.alias("w")).select("group_id", "w.field", "w.paper_id").where(F.col("paper_id").isNotNull())


FIELDS = ("venue", "abstract", "citation_count", "doi")


def merged_record(papers: DataFrame, winners: DataFrame) -> DataFrame:
    """One built record per group: each field's value from its winning record, and that record's id."""
    source = papers.select(F.col("id").alias("paper_id"), *FIELDS)
    met = winners.join(source, "paper_id")
    pick = [F.max(F.when(F.col("field") == f, F.col(c))).alias(n) for f in FIELDS for c, n in ((f, f), ("paper_id", f"{f}_from"))]
    return met.groupBy("group_id").agg(*pick)
