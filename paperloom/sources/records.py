"""Source records of three formats turned into papers, and the sinks that keep them current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperloom.functions.records import with_works
from paperloom.functions.text import normalize_doi, normalize_title

#: Record types that never become papers.
JUNK_TYPES = ("paratext", "editorial", "erratum", "supplementary-materials", "peer-review", "retraction")

ATOM_ENTRY = "id string, title string, summary string, published string, doi string, journal_ref string, author array<struct<name:string>>"
PUBMED_ARTICLE = "pmid string, title string, abstract array<struct<_VALUE:string,_Label:string>>, year string, journal string, doi string, author array<struct<ForeName:string,LastName:string,CollectiveName:string>>, type array<string>"


def opened(records: DataFrame) -> DataFrame:
    """One row per work of every readable record, as a VARIANT ``v``: text in text, result pages and lists are opened."""
    held = with_works(records, "raw", "_works")
    return held.select(*records.columns, F.explode("_works").alias("v")).where(F.col("v").isNotNull() & ~F.is_variant_null("v"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _inverted(index: Column) -> Column:
    """The text of an inverted index: words by position, then alphabetically."""
    entries = F.map_entries(index)
    placed = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return _blank(F.array_join(F.transform(F.array_sort(placed), lambda x: x["word"]), " "))


def _names(path: str, name: str | None) -> Column:
    many = F.coalesce(_get(path, "array<variant>"), F.array(_get(path, "variant")))
    named = F.transform(many, lambda a: _blank(F.try_variant_get(a, f"$.{name}" if name else "$", "string")))
    kept = F.filter(named, lambda n: n.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def extract_venue() -> Column:
    """The first named source of the primary location and the others, else the first raw name."""
    others = F.coalesce(_get("$.locations", "array<variant>"), F.array(_get("$.locations", "variant")))
    places = F.concat(F.array(_get("$.primary_location", "variant")), others)
    pick = lambda path: F.get(F.filter(F.transform(places, lambda p: _blank(F.try_variant_get(p, path, "string"))), lambda n: n.isNotNull()), F.lit(0))
    return F.coalesce(pick("$.source.display_name"), pick("$.raw_source_name"))


def derive_papers(records: DataFrame) -> DataFrame:
    """One derived paper per work of a readable record: the fields of its own format, under common names."""
    v = opened(records)
    openalex, arxiv = F.col("source") == "openalex", F.col("source") == "arxiv"
    title = _blank(F.coalesce(_get("$.display_name"), _get("$.title")))
    year = F.coalesce(_get("$.publication_year", "int"), _get("$.year", "int"), F.try_to_number(F.substring(_get("$.published"), 1, 4), F.lit("9999")).cast("int"))
    abstract = F.coalesce(_inverted(_get("$.abstract_inverted_index", "map<string,array<int>>")), _blank(_get("$.summary")), _blank(_get("$.abstract")))
    out = v.select(
        F.col("id").alias("record_id"), "source", "source_id", "fetched_at", "paper_id", "query_name",
        title.alias("title"), normalize_title(title).alias("title_norm"), abstract.alias("abstract"), year.alias("year"),
        F.when(openalex, extract_venue()).when(arxiv, _blank(_get("$.journal_ref"))).otherwise(_blank(_get("$.journal"))).alias("venue"),
        F.coalesce(_get("$.cited_by_count", "int"), F.lit(0)).alias("citation_count"),
        normalize_doi(_get("$.doi")).alias("doi"),
        F.when(arxiv, F.regexp_replace(F.coalesce(_get("$.arxiv_id"), _get("$.id")), "v[0-9]+$", "")).alias("arxiv_id"),
        F.when(openalex, F.regexp_replace(_get("$.ids.pmid"), "^.*/", "")).when(~arxiv, _get("$.pmid")).alias("pubmed_id"),
        F.coalesce(_get("$.is_retracted", "boolean"), F.lit(False)).alias("is_retracted"),
        F.when(openalex, _names("$.authorships", "author.display_name")).otherwise(_names("$.authors", None)).alias("authors"),
        _get("$.type").alias("type"),
    )
    return out


def papers_only(derived: DataFrame) -> DataFrame:
    """Without the types that are no papers; their records stay where they are."""
    return derived.where(F.col("title").isNotNull() & ~F.coalesce(F.col("type").isin(*JUNK_TYPES), F.lit(False)))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files as derived papers."""
    e = spark.read.format("xml").option("rowTag", "entry").schema(ATOM_ENTRY).load(path)
    names = F.filter(F.transform("author", lambda a: _blank(a["name"])), lambda n: n.isNotNull())
    title = F.regexp_replace(F.trim("title"), r"\s+", " ")
    return e.select(
        F.lit("arxiv").alias("source"),
        F.regexp_replace(F.regexp_replace("id", "^.*/abs/", ""), "v[0-9]+$", "").alias("source_id"),
        title.alias("title"), normalize_title(title).alias("title_norm"), _blank(F.regexp_replace("summary", r"\s+", " ")).alias("abstract"),
        F.substring("published", 1, 4).cast("int").alias("year"), F.col("journal_ref").alias("venue"), normalize_doi(F.col("doi")).alias("doi"),
        F.when(F.size(names) > 0, names).alias("authors"), F.lit(False).alias("is_retracted"),
    )


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of XML files as derived papers: labelled sections joined, collective names kept."""
    a = spark.read.format("xml").option("rowTag", "article").schema(PUBMED_ARTICLE).load(path)
    section = lambda s: F.when(s["_Label"].isNotNull(), F.concat(s["_Label"], F.lit(": "), s["_VALUE"])).otherwise(s["_VALUE"])
    person = lambda x: _blank(F.coalesce(x["CollectiveName"], F.concat_ws(" ", x["ForeName"], x["LastName"])))
    names = F.filter(F.transform("author", person), lambda n: n.isNotNull())
    return a.select(
        F.lit("pubmed").alias("source"), F.col("pmid").alias("source_id"), F.col("title"), normalize_title(F.col("title")).alias("title_norm"),
        _blank(F.array_join(F.transform("abstract", section), " ")).alias("abstract"),
        F.nullif(F.regexp_extract("year", "([0-9]{4})", 1), F.lit("")).cast("int").alias("year"), F.col("journal").alias("venue"),
        normalize_doi(F.col("doi")).alias("doi"), F.when(F.size(names) > 0, names).alias("authors"),
        F.coalesce(F.array_contains("type", "Retracted Publication"), F.lit(False)).alias("is_retracted"),
    )


def latest_records(records: DataFrame) -> DataFrame:
    """One row per (source, source_id): the latest raw, the first known query."""
    key = ["source", "source_id"]
    return records.groupBy(*key).agg(
        F.max(F.struct("fetched_at", "id", "raw", "paper_id")).alias("m"),
        F.min(F.when(F.col("query_name").isNotNull(), F.struct("fetched_at", "id", "query_name"))).alias("q"),
        F.count(F.lit(1)).alias("fetches"),
    ).select(*key, F.col("m.id").alias("id"), F.col("m.raw").alias("raw"), F.col("m.fetched_at").alias("fetched_at"), F.col("m.paper_id").alias("paper_id"), F.col("q.query_name").alias("query_name"), "fetches")


def create_or_link(derived: DataFrame, papers: DataFrame) -> DataFrame:
    """(record_id, paper_id, new_record, outcome): linked to the paper of an equal DOI, else to the first new record of it, else new.

    ``new_record`` is the record that brings in a paper which is not there yet; of several new records of one DOI it is the smallest.
    """
    held = papers.select(normalize_doi(F.col("doi")).alias("doi"), "id").where("doi is not null").groupBy("doi").agg(F.min("id").alias("held"))
    first = derived.where("doi is not null").groupBy("doi").agg(F.min("record_id").alias("first"))
    met = derived.select("record_id", "doi").join(held, "doi", "left").join(first, "doi", "left")
    new = F.when(F.col("held").isNull(), F.coalesce("first", "record_id"))
    linked = F.col("held").isNotNull() | (F.col("record_id") != F.coalesce("first", "record_id"))
    return met.select("record_id", F.col("held").alias("paper_id"), new.alias("new_record"), F.when(linked, "linked").otherwise("new").alias("outcome")).distinct()


#: Fields of a paper that its owner's record rewrites.
MUTABLE = ("title", "title_norm", "abstract", "year", "venue", "citation_count", "is_retracted", "authors")


def owners(records: DataFrame) -> DataFrame:
    """(paper_id, owner): the smallest record id of each paper owns it."""
    return records.where(F.col("paper_id").isNotNull()).groupBy("paper_id").agg(F.min("id").alias("owner"))


def refresh(papers: DataFrame, derived: DataFrame, owner: DataFrame) -> DataFrame:
    """Papers with what their owner's record says now, in every mutable field; a changed text drops the embedding."""
    own = derived.join(owner, (derived["paper_id"] == owner["paper_id"]) & (derived["record_id"] == owner["owner"])).select(
        derived["paper_id"].alias("id"), *[F.col(c).alias(f"new_{c}") for c in MUTABLE]
    )
    both = papers.join(own, "id")
    moved = ~F.col("title").eqNullSafe(F.col("new_title")) | ~F.col("abstract").eqNullSafe(F.col("new_abstract"))
    return both.select("id", *[F.col(f"new_{c}").alias(c) for c in MUTABLE], moved.alias("text_changed"), F.when(~moved, F.col("embedding")).alias("embedding"))


def outcomes(records: DataFrame) -> DataFrame:
    """Per query the records fetched, new, linked to a paper that a record fetched earlier holds, fetched again (with another text or not) and unreadable."""
    w = Window.partitionBy("source", "source_id").orderBy("fetched_at", "id")
    of_paper = Window.partitionBy(F.coalesce(F.col("paper_id"), -F.col("id"))).orderBy("fetched_at", "id")  # one without a paper stands alone
    marked = records.select("*", F.row_number().over(w).alias("at"), F.lag("raw").over(w).alias("before"), F.row_number().over(of_paper).alias("nth"))
    bad = F.try_parse_json("raw").isNull()
    first = F.col("at") == 1
    return marked.groupBy(F.coalesce("query_name", F.lit("(none)")).alias("query_name")).agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(first & (F.col("nth") == 1) & ~bad).alias("new"), F.count_if(first & (F.col("nth") > 1) & ~bad).alias("linked"),
        F.count_if(~first & ~bad).alias("refreshed"), F.count_if(~first & ~bad & ~F.col("raw").eqNullSafe(F.col("before"))).alias("text_changed"), F.count_if(bad).alias("skipped")
    )


def split_budget(weights: DataFrame, total: int) -> DataFrame:
    """(idx, share): ``total`` split by weight, the largest remainders first, ties to the lower index."""
    whole = weights.where("weight > 0").agg(F.sum("weight").alias("sum"))
    exact = weights.where("weight > 0").join(F.broadcast(whole)).withColumn("exact", F.col("weight") * total / F.col("sum"))  # one row
    base = exact.withColumn("base", F.floor("exact")).withColumn("at", F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("base")), "idx")))
    left = total - F.sum("base").over(Window.partitionBy())
    return base.select("idx", (F.col("base") + F.when(F.col("at") <= left, 1).otherwise(0)).cast("long").alias("share"))


def year_slices(papers: DataFrame, last: int = 2024, years: int = 10) -> DataFrame:
    """(slice, n): one slice a year for the last ``years``, one for all before."""
    name = F.when(F.col("year") > last - years, F.col("year").cast("string")).when(F.col("year").isNotNull(), "pre").otherwise("none")
    return papers.groupBy(name.alias("slice")).agg(F.count(F.lit(1)).alias("n"))
