"""Corpus, provenance and coverage figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def corpus_totals(papers: DataFrame) -> DataFrame:
    """One pass, one row."""
    return papers.agg(
        F.count(F.lit(1)).alias("papers"),
        F.count_if("is_retracted").alias("retracted"),
        F.count("abstract").alias("with_abstract"),
        F.count("doi").alias("with_doi"),
        F.count("embedding").alias("embedded"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def by_source(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source_id").alias("distinct_records"), F.count_distinct("paper_id").alias("papers"))


def records_by_query(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("query_name", F.lit("(unknown)")).alias("query_name")).agg(F.count(F.lit(1)).alias("n"))


def papers_by_query(records: DataFrame) -> DataFrame:
    """Papers under the query of their earliest record."""
    first = records.where("paper_id is not null").groupBy("paper_id").agg(F.min(F.struct("fetched_at", "id", "query_name")).alias("m"))
    return first.groupBy(F.coalesce("m.query_name", F.lit("(unknown)")).alias("query_name")).agg(F.count(F.lit(1)).alias("n"))


def embedding_coverage(papers: DataFrame, records: DataFrame, as_of: str = "2025-01-01 00:00:00") -> DataFrame:
    """Papers with and without a vector; those awaiting deduplication have a record of another source, the stalled have not."""
    other = records.where((F.col("source") != "openalex") & F.col("paper_id").isNotNull()).select(F.col("paper_id").alias("id")).distinct().withColumn("other", F.lit(True))
    p = papers.select("id", "created_at", F.col("embedding").isNull().alias("missing")).join(other, "id", "left")
    old = F.col("created_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr("interval 1 hour")
    return p.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("missing")).alias("embedded"),
        F.count_if("missing").alias("missing"),
        F.count_if(F.col("missing") & F.col("other").isNotNull()).alias("awaiting_dedup"),
        F.count_if(F.col("missing") & F.col("other").isNull() & old).alias("stalled"),
    )


def pairs_by_strategy(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("low"), F.max("similarity").alias("high"))


def citation_tail(papers: DataFrame) -> DataFrame:
    """Pearson's and Spearman's correlation of year and credible citations; ranks of ties are averaged."""
    p = papers.select(F.col("year").cast("double").alias("x"), F.col("citation_count").cast("double").alias("y")).where("x is not null and y is not null and y >= 0 and y < 900000")
    # ranks from counts of the distinct values: the windows see those, not the rows
    def ranks(c: str) -> DataFrame:
        n = p.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return n.select(c, (before + (F.col("n") + 1) / 2).alias(f"r{c}"))

    both = p.join(ranks("x"), "x").join(ranks("y"), "y")
    return both.agg(F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"), F.count(F.lit(1)).alias("n"))


def top_per_query(papers: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """(query_name, id, rank): the k most cited papers of each query."""
    of = records.where("query_name is not null and paper_id is not null").select("query_name", F.col("paper_id").alias("id")).distinct()
    w = Window.partitionBy("query_name").orderBy(F.col("citation_count").desc_nulls_last(), "id")
    return of.join(papers.select("id", "citation_count"), "id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_name", "id", "rank")


def even_sample(papers: DataFrame, n: int) -> DataFrame:
    """At most n rows spread evenly over the ids, by each row's place in the order of ids.

    Places come from per-range counts, so no task sees all rows.
    """
    total = papers.count()
    step = max(1, total // max(1, n))
    ranged = papers.select("id").repartitionByRange("id").withColumn("part", F.spark_partition_id())
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    start = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("id")) + F.col("start")
    placed = ranged.join(F.broadcast(start), "part").withColumn("at", at)  # one row per partition
    return placed.where(F.pmod(F.col("at") - 1, F.lit(step)) == 0).where(F.col("at") <= step * n).select("id")


def stratified_sample(papers: DataFrame, by: str, each: int, seed: str = "s") -> DataFrame:
    """(stratum, id): ``each`` rows of every stratum in the order of a seeded hash."""
    w = Window.partitionBy("stratum").orderBy("h", "id")
    rows = papers.select(F.col(by).alias("stratum"), "id").withColumn("h", F.md5(F.concat(F.col("id").cast("string"), F.lit(seed))))
    return rows.withColumn("at", F.row_number().over(w)).where(F.col("at") <= each).select("stratum", "id")


def fill_buckets(sizes: list[tuple[int, int, bool]], budget: int) -> list[int]:
    """The buckets (id, size, required) that fit a budget: required ones first, then any that still fit, in order of ids.

    The sizes are one row per bucket; the fill skips what is too large, so it is no prefix sum.
    """
    taken, used = [], 0
    for i, size, required in sorted(sizes, key=lambda x: (not x[2], x[0])):
        if required and used + size > budget:
            raise ValueError("the required buckets alone exceed the budget")
        if used + size <= budget:
            taken.append(i)
            used += size
    return taken


def embed_backlog(papers: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """(id, text): what an encoder still has to read, lowest id first; a boilerplate abstract leaves the title alone."""
    from paperloom.functions.text import document_text

    known = boilerplate.select(F.col("abstract_md5").alias("md5")).distinct().withColumn("boiler", F.lit(True))
    p = papers.where(F.col("embedding").isNull()).withColumn("md5", F.md5("abstract")).join(known, "md5", "left")
    return p.select("id", F.when(F.col("boiler"), F.col("title")).otherwise(document_text(F.col("title"), F.col("abstract"))).alias("text"))


def proportional_subset(owned: DataFrame, papers: DataFrame, bucket: str, total: int) -> DataFrame:
    """(bucket, id, rank): an equal share of ``total`` for each bucket, its most cited papers first (nulls last, ties by id)."""
    share = owned.agg(F.greatest(F.lit(1), F.floor(F.lit(total) / F.count_distinct(bucket))).alias("share"))  # one row
    w = Window.partitionBy(bucket).orderBy(F.col("citation_count").desc_nulls_last(), "id")
    ranked = owned.join(papers.select("id", "citation_count"), "id").withColumn("rank", F.row_number().over(w))
    return ranked.join(F.broadcast(share)).where(F.col("rank") <= F.col("share")).select(bucket, "id", "rank")


def mean_and_error(rows: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n, mean, stdev, error): the sample mean with its standard error; null deviations below two values."""
    sound = rows.where(F.col(value).isNotNull())
    agg = sound.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp(value)).alias("stdev"))
    return agg.select(by, "n", "mean", "stdev", (F.col("stdev") / F.sqrt("n")).alias("error"))
