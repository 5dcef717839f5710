"""Named queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.bpe import encode_corpus
from paperloom.llm.components import connected_groups, strong_links
from paperloom.llm.consensus import current_labels, fit_consensus, krippendorff
from paperloom.llm.language import document_languages, mislabelled, segment_languages
from paperloom.llm.leakage import item_matches, leaked_pairs, without_leaks
from paperloom.llm.matching import match_records
from paperloom.llm.names import author_names, entity_spellings, spelling_pairs
from paperloom.llm.neighbours import nearest_neighbours, neighbour_pairs
from paperloom.llm.survivorship import best_records, merged_record
from paperloom.session import read_table

Query = Callable[[SparkSession, str], DataFrame]

#: A pair of records is a link from this similarity on.
LINK_SIMILARITY = 0.92


def record_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_groups(strong_links(read_table(spark, sf_dir, "pairs"), LINK_SIMILARITY))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_pairs(entity_spellings(author_names(read_table(spark, sf_dir, "papers"))))


def p1_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_spellings(author_names(read_table(spark, sf_dir, "papers")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_records(read_table(spark, sf_dir, "papers"), record_groups(spark, sf_dir), max_size=8)


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One built record per group; of equal values that of the curated catalogue, then the latest, is taken."""
    papers = read_table(spark, sf_dir, "papers")
    curated = F.when(F.col("pubmed_id").isNotNull(), 2).when(F.col("arxiv_id").isNotNull(), 0).otherwise(1)
    return merged_record(papers, best_records(papers, record_groups(spark, sf_dir), max_size=8, priority=curated, timestamp=F.col("created_at")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_groups(spark, sf_dir).withColumnRenamed("id", "paper_id")


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_records(read_table(spark, sf_dir, "arxiv_fields"), read_table(spark, sf_dir, "pubmed_fields"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).select("rec_a", "rec_b").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(nearest_neighbours(read_table(spark, sf_dir, "papers"), "id", "embedding", dim=384, k=5))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fit_consensus(current_labels(read_table(spark, sf_dir, "screenings"))).items
    return found.select(F.col("c").alias("collection_id"), F.col("p").alias("paper_id"), "decision")


def p7_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_consensus(current_labels(read_table(spark, sf_dir, "screenings"))).annotators.withColumnRenamed("u", "user_id")


def p7_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return krippendorff(current_labels(read_table(spark, sf_dir, "screenings"))).withColumnRenamed("c", "collection_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(item_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark_items")))


def p9_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark_items"))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the documents that remain when the leaking ones are removed."""
    return without_leaks(read_table(spark, sf_dir, "documents"), p9_found(spark, sf_dir)).select("doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled(document_languages(read_table(spark, sf_dir, "documents"))).select("doc_id", "lang")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_languages(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_spellings": p1_spellings,
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_matches": p4_matches,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_raters": p7_raters,
    "p7_agreement": p7_agreement,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_matches": p9_matches,
    "p9_kept": p9_kept,
    "p10_found": p10_found,
    "p10_segments": p10_segments,
}

ORACLE: dict[str, str] = {
    "p3_found": """
        WITH RECURSIVE e AS (
            SELECT a, b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b AND similarity >= 0.92 AND NOT isnan(similarity)
        ), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(id, low) AS (SELECT a, a FROM d UNION SELECT d.b, r.low FROM r JOIN d ON d.a = r.id WHERE r.low < d.b)
        SELECT id AS paper_id, min(low) AS group_id FROM r GROUP BY id
    """,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
