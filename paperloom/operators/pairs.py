"""Duplicate candidates: one function per strategy, each giving (a, b, sim) with a < b.

Equality strategies fan out from the smallest id of a group (a star), so a group of n
rows gives n - 1 pairs. Fuzzy strategies join on a block key, drop repeated pairs before
they score, and score trigram sets that are computed once per title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.records import with_works
from paperloom.functions.text import in_length_band, set_similarity, siblings, trigrams

FLOOR, GATE, ABSTRACT_GATE = 0.85, 0.92, 0.80
LEAST_TITLE, LEAST_SURNAME = 20, 3
#: The order in which a pair found twice is attributed.
STRATEGIES = ("doi_exact", "jmir_doi", "id_exact", "abstract_hash", "title_exact", "title_trgm", "preprint_trgm")
PREPRINT_VENUE = "(?i)arxiv|biorxiv|medrxiv|preprint|research square|ssrn"


#: Rows of a block that one task may compare with each other; larger blocks are split.
HOT_BLOCK = 1_000


def block_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, hot: int = HOT_BLOCK) -> DataFrame:
    """The inner join on ``keys``, with large blocks cut into a grid of cells of at most about ``hot`` by ``hot`` rows.

    A row of a large block is copied to the cells of its row or column of the grid; every pair meets in exactly one.
    """
    parts = lambda rows, name: rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias(name))
    large = parts(left, "nl").join(parts(right, "nr"), keys).where("nl > 1 or nr > 1")

    def cells(rows: DataFrame, own: str, mine: str, other: str, n_mine: str, n_other: str) -> DataFrame:
        met = rows.join(large, keys, "left")
        at = F.pmod(F.xxhash64(own), F.coalesce(F.col(n_mine), F.lit(1))).cast("int").alias(mine)
        over = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n_other), F.lit(1)) - 1)).alias(other)
        return met.select(*rows.columns, at, over)

    return cells(left, left_id, "_l", "_r", "nl", "nr").join(cells(right, right_id, "_r", "_l", "nr", "nl"), [*keys, "_l", "_r"]).drop("_l", "_r")


def star(rows: DataFrame, *key: Column) -> DataFrame:
    """The smallest id of each key with each other id of it."""
    keyed = rows.select("id", *[k.alias(f"k{i}") for i, k in enumerate(key)]).dropna()
    names = [f"k{i}" for i in range(len(key))]
    low = keyed.groupBy(*names).agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(low, names).where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"), F.lit(1.0).alias("sim")).distinct()


def doi_exact(papers: DataFrame) -> DataFrame:
    return star(papers, F.col("doi"))


def doi_transform(papers: DataFrame, old: str = "/preprints.", new: str = "/") -> DataFrame:
    """A DOI that becomes another record's once ``old`` is replaced."""
    p = papers.where(F.contains("doi", F.lit(old))).select(F.col("id").alias("p"), F.replace("doi", F.lit(old), F.lit(new)).alias("doi"))
    q = papers.select(F.col("id").alias("q"), "doi")
    return p.join(q, "doi").where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.lit(1.0).alias("sim")).distinct()


def id_exact(papers: DataFrame) -> DataFrame:
    return star(papers, F.col("arxiv_id")).unionByName(star(papers, F.col("pubmed_id"))).distinct()


def abstract_hash(papers: DataFrame, boilerplate: DataFrame | None = None) -> DataFrame:
    keyed = papers.withColumn("md5", F.md5("abstract"))
    if boilerplate is not None:
        keyed = keyed.join(boilerplate.select(F.col("abstract_md5").alias("md5")), "md5", "left_anti")
    return star(keyed, F.col("md5"))


def abstract_title(papers: DataFrame, boilerplate: DataFrame | None = None, gate: float = ABSTRACT_GATE) -> DataFrame:
    """Pairs of an equal abstract, not a boilerplate one, whose titles are alike and no siblings.

    Records of one abstract are grouped by title first: equal titles pair by a star (they are
    copies of each other, so the star loses no link), different ones between the titles' smallest ids.
    """
    keyed = papers.select("id", F.md5("abstract").alias("k"), "title_norm").dropna()
    if boilerplate is not None:
        keyed = keyed.join(boilerplate.select(F.col("abstract_md5").alias("k")), "k", "left_anti")
    same = star(keyed, F.col("k"), F.col("title_norm"))
    low = keyed.groupBy("k", "title_norm").agg(F.min("id").alias("id")).withColumn("g", trigrams(F.col("title_norm")))
    x = low.select("k", F.col("id").alias("x"), F.col("title_norm").alias("t"), F.col("g").alias("gx"))
    y = low.select("k", F.col("id").alias("y"), F.col("title_norm").alias("u"), F.col("g").alias("gy"))
    met = block_join(x, y, ["k"], "x", "y").where((F.col("x") < F.col("y")) & ~siblings(F.col("t"), F.col("u")))
    scored = met.select(F.col("x").alias("a"), F.col("y").alias("b"), set_similarity(F.col("gx"), F.col("gy")).alias("sim")).where(F.col("sim") >= gate)
    return same.unionByName(scored)


def title_exact(papers: DataFrame, least: int = 20) -> DataFrame:
    return star(papers.where(F.length("title_norm") >= least), F.col("title_norm"), F.col("year"))


def surname_blocks(papers: DataFrame) -> DataFrame:
    """(id, surname): each record under the last word of each of its authors."""
    names = papers.select("id", F.explode("authors").alias("author"))
    return names.select("id", F.lower(F.element_at(F.split("author", " "), -1)).alias("surname")).where(F.length("surname") > 0).distinct()


def record_marks(records: DataFrame) -> DataFrame:
    """(id): the papers with a record of a preprint source or, where the raw text is at hand, of the type preprint, in any wrapping."""
    if "raw" not in records.columns:
        records = records.withColumn("raw", F.lit(None).cast("string"))
    records = with_works(records.select("source", "paper_id", "raw"), "raw", "_works")
    kind = F.exists("_works", lambda w: F.coalesce(F.try_variant_get(w, "$.type", "string") == "preprint", F.lit(False)))
    early = (F.col("source") == "arxiv") | F.coalesce(kind, F.lit(False))
    return records.where(F.col("paper_id").isNotNull() & early).select(F.col("paper_id").alias("id")).distinct()


def preprints(papers: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """The papers that their identifiers, their venue or a record of theirs mark as preprints."""
    marked = F.col("arxiv_id").isNotNull() | F.coalesce(F.contains("doi", F.lit("/preprints.")), F.lit(False)) | F.coalesce(F.col("venue").rlike(PREPRINT_VENUE), F.lit(False))
    if records is None:
        return papers.where(marked)
    held = record_marks(records).withColumn("_early", F.lit(True))
    return papers.join(held, "id", "left").where(marked | F.col("_early")).drop("_early")


def _blocked(papers: DataFrame) -> DataFrame:
    """(id, surname, year, title_norm) of records with a year and a title that can be told apart, under surnames that are no initials."""
    sound = papers.select("id", "year", "title_norm").where(F.col("year").isNotNull() & (F.length("title_norm") >= LEAST_TITLE))
    return surname_blocks(papers).where(F.length("surname") >= LEAST_SURNAME).join(sound, "id")


def _scored(met: DataFrame, titles: DataFrame, floor: float) -> DataFrame:
    grams = titles.select("id", trigrams(F.col("title_norm")).alias("g"))
    both = met.join(grams.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(grams.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    return both.select("a", "b", set_similarity(F.col("ga"), F.col("gb")).alias("sim")).where(F.col("sim") >= floor)


def title_trgm(papers: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Alike but different titles of one year that share an author's surname."""
    rows = _blocked(papers)
    x = rows.select("surname", "year", F.col("id").alias("a"), F.col("title_norm").alias("t"))
    y = rows.select("surname", "year", F.col("id").alias("b"), F.col("title_norm").alias("u"))
    met = block_join(x, y, ["surname", "year"], "a", "b").where((F.col("a") < F.col("b")) & (F.col("t") != F.col("u")) & in_length_band(F.col("t"), F.col("u")))
    return _scored(met.select("a", "b").distinct(), papers, floor)


def preprint_trgm(papers: DataFrame, floor: float = FLOOR, records: DataFrame | None = None) -> DataFrame:
    """A preprint and a record of the year before or after its own that share a surname; equal titles are allowed."""
    rows = _blocked(papers)
    early = rows.join(preprints(papers, records).select("id"), "id", "left_semi")
    p = early.select("surname", F.explode(F.array(F.col("year") - 1, F.col("year") + 1)).alias("year"), F.col("id").alias("p"), F.col("title_norm").alias("t"))
    q = rows.select("surname", "year", F.col("id").alias("q"), F.col("title_norm").alias("u"))
    met = block_join(p, q, ["surname", "year"], "p", "q").where((F.col("p") != F.col("q")) & in_length_band(F.col("t"), F.col("u")))
    return _scored(met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), papers, floor)


def merge_ready(scored: DataFrame, papers: DataFrame, gate: float = GATE) -> DataFrame:
    """The fuzzy pairs at or above the gate that are no siblings."""
    t = papers.select("id", "title_norm")
    both = scored.where(F.col("sim") >= gate).join(t.select(F.col("id").alias("a"), F.col("title_norm").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("title_norm").alias("tb")), "b")
    return both.where(~siblings(F.col("ta"), F.col("tb"))).select("a", "b", "sim")


def all_pairs(papers: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(a, b, sim, strategy) of every strategy, in one table."""
    found = {
        "doi_exact": doi_exact(papers),
        "jmir_doi": doi_transform(papers),
        "id_exact": id_exact(papers),
        "abstract_hash": abstract_title(papers, boilerplate_seed(papers)),
        "title_exact": title_exact(papers),
        "title_trgm": merge_ready(title_trgm(papers), papers),
        "preprint_trgm": merge_ready(preprint_trgm(papers, records=records), papers),
    }
    out = None
    for name in STRATEGIES:
        part = found[name].select("a", "b", "sim", F.lit(name).alias("strategy"))
        out = part if out is None else out.unionByName(part)
    return out


def strategy_rank(strategy: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), strategy), F.lit(99))


def attributed(pairs: DataFrame) -> DataFrame:
    """Each pair once, in order of ids, under its earliest strategy (of equal ones the greater sim)."""
    ends = pairs.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim", "strategy")
    best = F.min(F.struct(strategy_rank(F.col("strategy")).alias("r"), (-F.col("sim")).alias("s"), "strategy"))
    return ends.groupBy("a", "b").agg(best.alias("m")).select("a", "b", (-F.col("m.s")).alias("sim"), F.col("m.strategy").alias("strategy"))


def threshold_sweep(scored: DataFrame, papers: DataFrame, thresholds: tuple[float, ...] = (0.85, 0.90, 0.92, 0.95, 0.98)) -> DataFrame:
    """(threshold, kept, refused): pairs at or above each threshold, siblings counted apart."""
    t = papers.select("id", "title_norm")
    both = scored.join(t.select(F.col("id").alias("a"), F.col("title_norm").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("title_norm").alias("tb")), "b")
    marked = both.select("sim", siblings(F.col("ta"), F.col("tb")).alias("sib"))
    one = marked.agg(*[F.struct(F.lit(x).alias("threshold"), F.count_if((F.col("sim") >= x) & ~F.col("sib")).alias("kept"), F.count_if((F.col("sim") >= x) & F.col("sib")).alias("refused")).alias(f"c{i}") for i, x in enumerate(thresholds)])
    return one.select(F.inline(F.array(*[f"c{i}" for i in range(len(thresholds))])))


def boilerplate_seed(papers: DataFrame, prefixes: tuple[str, ...] = (), short: int = 50, medium: int = 100, shared: int = 5) -> DataFrame:
    """(abstract_md5, reason, n, sample): abstracts that describe no work; the first rule that hits counts."""
    by = papers.where(F.col("abstract").isNotNull()).groupBy(F.md5("abstract").alias("abstract_md5")).agg(F.count(F.lit(1)).alias("n"), F.min("abstract").alias("text"))
    long = F.length("text")
    reason = F.when(long < short, "too short").when((long < medium) & (F.col("n") >= shared), "short and shared")
    for p in prefixes:
        reason = reason.when(F.startswith("text", F.lit(p)) & (F.col("n") >= shared), "known prefix")
    return by.select("abstract_md5", reason.alias("reason"), "n", F.substring("text", 1, 120).alias("sample")).where(F.col("reason").isNotNull())


def minus_negative(pairs: DataFrame, negative: DataFrame) -> DataFrame:
    """The pairs nobody has refused."""
    return pairs.join(negative.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")


def source_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(how, n): records of ``left`` also in ``right`` by DOI, else by title, else nowhere."""
    dois = right.select(F.col("doi").alias("k")).dropna().distinct().withColumn("by_doi", F.lit(True))
    titles = right.select(F.col("title_norm").alias("t")).dropna().distinct().withColumn("by_title", F.lit(True))
    met = left.join(dois, left["doi"] == F.col("k"), "left").join(titles, left["title_norm"] == F.col("t"), "left")
    how = F.when(F.col("by_doi"), "doi").when(F.col("by_title"), "title").otherwise("none")
    return met.groupBy(how.alias("how")).agg(F.count(F.lit(1)).alias("n"))
