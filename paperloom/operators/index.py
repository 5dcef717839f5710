"""Indexes kept as tables: postings by term, vectors by cell. A query reads the files of its terms or cells only.

Postings are written in buckets of terms, each sorted by term, so that the bucket prunes files
and the term prunes row groups; a frequent term is spread over ``SPREAD`` files by document. A
posting holds the places of the term in the title and the abstract, the document's length and its
year, so matching, phrases, bounds and BM25 need no text. Vectors are written at unit length
under their nearest centroid, beside the year; a filter on it reaches the scan, and more cells are read until
enough rows pass it.

Defined results: a query without words, or of unknown words, matches nothing; stop words have no
postings; rows without a sound vector are in no cell; ties go to the smaller id; building again
replaces the index.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.operators.search import B, K1, KeywordQuery, analysed, fit_cells, fuse, in_cells, nearest_in, parse_query, sound_vectors, year_between

BUCKETS, SPREAD = 256, 8
MODES = ("keyword", "vector", "hybrid")
MOST_K, MOST_DEPTH = 100, 1_000


_OPENED: dict[tuple, dict] = {}


def _opened(spark: SparkSession, path: str) -> dict:
    """The tables of an index with their listed files, its figures and its centroids, looked up once for a session."""
    key = (spark.sparkContext.applicationId, path)
    return _OPENED.setdefault(key, {})


def _forget(spark: SparkSession, path: str) -> None:
    _OPENED.pop((spark.sparkContext.applicationId, path), None)


def _postings(spark: SparkSession, path: str) -> tuple:
    held = _opened(spark, path)
    if "postings" not in held:
        read = lambda schema, name: spark.read.schema(schema).parquet(f"{path}/{name}")
        figures = read("n long, mean double, buckets int", "figures").first()
        held["postings"] = (figures, read("term string, df long, bucket int", "terms"), read("term string, id long, year int, length int, title array<int>, abstract array<int>, bucket int", "postings"))
    return held["postings"]


def _cells(spark: SparkSession, path: str) -> tuple:
    held = _opened(spark, path)
    if "cells" not in held:
        centres = spark.read.schema("cell int, centre array<float>, probes int").parquet(f"{path}/centres").orderBy("cell").collect()  # a row a cell
        held["cells"] = (centres, spark.read.schema("id long, year int, embedding array<float>, cell int").parquet(f"{path}/cells"))
    return held["cells"]


def build_postings(papers: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Postings, document frequencies and corpus figures of ``papers`` under ``path``."""
    _forget(papers.sparkSession, path)
    whole = analysed(papers).select("id", "year", "title_words", "abstract_words", (F.size("title_words") + F.size("abstract_words")).alias("length"))
    of = lambda c, field: F.transform(c, lambda w, i: F.struct(w.alias("term"), F.lit(field).alias("field"), i.alias("at")))
    words = whole.select("id", "year", "length", F.inline(F.concat(of(F.col("title_words"), 0), of(F.col("abstract_words"), 1))))
    bucket, salt = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")
    placed = words.withColumns({"bucket": bucket, "salt": salt}).repartition("bucket", "salt")
    places = lambda field: F.array_sort(F.collect_list(F.when(F.col("field") == field, F.col("at"))))
    postings = placed.groupBy("bucket", "salt", "term", "id", "year", "length").agg(places(0).alias("title"), places(1).alias("abstract"))  # a document's own places
    postings.drop("salt").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    held = papers.sparkSession.read.schema("term string, bucket int").parquet(f"{path}/postings")
    held.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    figures = whole.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    figures.withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/figures")


def _of_terms(table: DataFrame, terms: list[str], buckets: int) -> DataFrame:
    """The rows of the terms; both conditions are constants, so they prune partitions and row groups."""
    return table.where(F.col("bucket").isin(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in terms]) & F.col("term").isin(*terms))


def _holds(words: list[str], at: dict[str, int]) -> Column:
    """Whether a document holds the phrase in one of its fields."""
    first = F.col(f"t{at[words[0]]}")
    if len(words) == 1:
        return first.isNotNull()
    follows = lambda c, p: [F.array_contains(F.col(f"t{at[w]}")[c], p + i) for i, w in enumerate(words[1:], 1)]

    def inside(c: str) -> Column:
        def all_follow(p: Column) -> Column:
            out = F.lit(True)
            for x in follows(c, p):
                out = out & F.coalesce(x, F.lit(False))
            return out

        return F.exists(first[c], all_follow)

    return F.coalesce(inside("title") | inside("abstract"), F.lit(False))


def _matches(query: KeywordQuery, at: dict[str, int]) -> Column:
    keep = F.lit(True)
    for group in query.groups:
        one = F.lit(False)
        for words in group:
            one = one | _holds(words, at)
        keep = keep & one
    for words in query.excluded:
        keep = keep & ~_holds(words, at)
    return keep


def search_postings(spark: SparkSession, path: str, text: str, k: int = 20, low: int | None = None, high: int | None = None) -> DataFrame:
    """(id, score): BM25 over the index, the same rows and scores as over the papers."""
    query = parse_query(text)
    figures, terms, postings = _postings(spark, path)
    if not query.groups or not figures["n"]:
        return spark.createDataFrame([], "id long, score double")
    every = list(dict.fromkeys([*query.terms, *[w for words in query.excluded for w in words]]))
    at = {t: i for i, t in enumerate(every)}
    df = {r["term"]: r["df"] for r in _of_terms(terms, every, figures["buckets"]).collect()}  # at most a row a term
    rows = _of_terms(postings, every, figures["buckets"]).where(year_between(low, high))
    held = [F.max(F.when(F.col("term") == t, F.struct("title", "abstract"))).alias(f"t{i}") for t, i in at.items()]
    found = rows.groupBy("id").agg(F.max("length").alias("length"), *held).where(_matches(query, at))
    score = F.lit(0.0)
    for t in query.terms:
        own = F.col(f"t{at[t]}")
        tf = F.coalesce(F.size(own["title"]) + F.size(own["abstract"]), F.lit(0)).cast("double")
        n = df.get(t, 0)
        idf = float(np.log1p((figures["n"] - n + 0.5) / (n + 0.5)))
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(float(figures["mean"]))))
    return found.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def build_cells(papers: DataFrame, path: str, dim: int, lists: int = 16, fit_rows: int = 5_000, k: int = 20) -> None:
    """The papers' sound vectors under their cells, and the centroids with the probes that ``fit_cells`` found to be needed at ``k``."""
    spark, rows = papers.sparkSession, sound_vectors(papers, dim)
    _forget(spark, path)
    centre, probes = fit_cells(rows, dim, k, lists, fit_rows)
    if len(centre):
        placed = in_cells(rows, centre).join(rows.select("id", "year"), "id")
    else:
        placed = rows.select("id", "embedding", F.lit(0).alias("cell"), "year")
    placed.select("id", "year", "embedding", "cell").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    table = [(i, [float(x) for x in c], probes) for i, c in enumerate(centre)]
    spark.createDataFrame(table, "cell int, centre array<float>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def search_cells(spark: SparkSession, path: str, query: list[float], k: int = 20, probes: int | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """(id, score): the nearest rows within the cells nearest to the query; with bounds, more cells are read until k rows pass or none is left."""
    held, rows = _cells(spark, path)
    rows = rows.where(year_between(low, high))
    q = np.array(query, np.float64)
    if not held:
        return nearest_in(rows, q, k)
    order = np.argsort(-(np.array([r["centre"] for r in held]) @ q), kind="stable").tolist()
    sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # from footers and the year column alone
    taken, passing = [], 0
    for c in order:
        if len(taken) >= (probes or held[0]["probes"]) and passing >= k:
            break
        taken.append(c)
        passing += sizes.get(c, 0)
    return nearest_in(rows.where(F.col("cell").isin(taken)), q, k)


def search(
    spark: SparkSession, path: str, papers: DataFrame, text: str = "", query: list[float] | None = None, mode: str = "hybrid", k: int = 20, depth: int = 200,
    probes: int | None = None, low: int | None = None, high: int | None = None,
) -> DataFrame:
    """(rank, id, doi, title, year, score, sources) in one of ``MODES`` over the indexes under ``path``.

    ``depth`` rows of each arm are fused; an arm always reads as many cells as it takes to bring ``depth`` rows.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if not 1 <= k <= MOST_K or not k <= depth <= MOST_DEPTH:
        raise ValueError(f"k is 1 to {MOST_K} and depth k to {MOST_DEPTH}")
    if low is not None and high is not None and low > high:
        raise ValueError("the lower bound is above the upper one")
    if mode != "vector" and not text.strip():
        raise ValueError(f"{mode} search needs a text")
    if mode != "keyword" and query is None:
        raise ValueError(f"{mode} search needs a vector")
    deep = depth if mode == "hybrid" else k
    words = search_postings(spark, path, text, deep, low, high) if mode != "vector" else None
    near = search_cells(spark, path, query, deep, probes, low, high) if mode != "keyword" else None
    if mode == "hybrid":
        fused = fuse(words, near, depth).orderBy(F.desc("score"), "id").limit(k)
        arms = F.array_compact(F.array(F.when(F.col("keyword_rank").isNotNull(), "keyword"), F.when(F.col("vector_rank").isNotNull(), "vector")))
        top = fused.select("id", "score", F.array_join(arms, "+").alias("sources"))
    else:
        top = (words if words is not None else near).withColumn("sources", F.lit(mode))
    wide = F.broadcast(top).join(papers.select("id", "doi", "title", "year"), "id")  # at most MOST_K rows are broadcast
    order = Window.orderBy(F.desc("score"), "id")
    return wide.withColumn("rank", F.row_number().over(order)).select("rank", "id", "doi", "title", "year", "score", "sources")
