"""Column functions on raw records: JSON in any wrapping as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text_at(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def elements_at(v: Column, path: str) -> Column:
    """The array at ``path``; a lone element becomes an array of one, a missing or null one an empty array."""
    lone = variant_at(v, path)
    empty = F.array().cast("array<variant>")
    return F.coalesce(
        F.try_variant_get(v, path, "array<variant>"),
        F.when(lone.isNotNull() & ~F.is_variant_null(lone), F.array(lone)),
        empty,
    )


def with_works(records: DataFrame, raw: str, name: str) -> DataFrame:
    """``records`` with an array of every record inside a raw text, whatever its wrapping; null where it is unreadable.

    Each step is a column of its own, so that a text is parsed once and not once for each use.
    """
    kept = records.columns
    parsed = records.withColumn("_first", F.try_parse_json(F.col(raw)))
    inner = parsed.withColumn("_inner", F.when(is_string(F.col("_first")), F.try_parse_json(text_at(F.col("_first")))).otherwise(F.col("_first")))
    lone = inner.withColumn("_results", variant_at(F.col("_inner"), "$.results"))
    there = F.col("_results").isNotNull() & ~F.is_variant_null("_results")
    out = F.coalesce(
        F.when(there, F.coalesce(F.try_variant_get("_results", "$", "array<variant>"), F.array("_results"))),
        F.try_variant_get("_inner", "$", "array<variant>"),
        F.when(F.col("_inner").isNotNull(), F.array("_inner")),
    )
    return lone.select(*[c for c in kept if c != name], out.alias(name))
