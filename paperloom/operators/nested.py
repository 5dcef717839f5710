"""Deeply nested records flattened into related tables.

A raw JSON text is parsed once into a VARIANT. Nested ``transform`` calls walk the
hierarchy and attach the record id and the ancestors' positions to every element,
``flatten`` merges the nested arrays, and a single ``inline`` per target table emits
the rows. No Python and no shuffle: the plan is one scan and one generator.

Defined results for odd input:

* null, empty, truncated or non-JSON raw: no row
* a JSON text wrapped in a JSON string, or in ``{"results": [...]}``, or in an array: unwrapped
* a lone element where an array is expected: position 0
* a null element, or one of another type: keeps its position and gives no row
* an author without a name: no author row, but its institutions and departments do
* a repeated input row repeats its output rows; equal rows inside one record are emitted once
* extra columns of the input, whatever their names, are ignored
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.records import elements_at, is_string, text_at, with_works

ROW = "array<struct<child:string,path:string,item:string>>"
CHILDREN = ("author", "institution", "department", "location")


def _row(child: str, path: Column, item: Column) -> Column:
    return F.struct(F.lit(child).alias("child"), path.alias("path"), item.alias("item"))


def _join(*positions: Column) -> Column:
    return F.concat_ws("/", *[p.cast("string") for p in positions])


def _authors(work: Column) -> Column:
    named = F.transform(elements_at(work, "$.authorships"), lambda a, i: _row("author", _join(i), text_at(a, "$.author.display_name")))
    return F.concat(named, _plain_authors(work))


def _plain_authors(work: Column) -> Column:
    return F.transform(elements_at(work, "$.authors"), lambda a, i: _row("author", _join(i), F.when(is_string(a), text_at(a))))


def _institutions(work: Column) -> Column:
    return F.flatten(
        F.transform(
            elements_at(work, "$.authorships"),
            lambda a, i: F.transform(
                elements_at(a, "$.institutions"), lambda x, j: _row("institution", _join(i, j), text_at(x, "$.id"))
            ),
        )
    )


def _departments(work: Column) -> Column:
    return F.flatten(
        F.transform(
            elements_at(work, "$.authorships"),
            lambda a, i: F.flatten(
                F.transform(
                    elements_at(a, "$.institutions"),
                    lambda x, j: F.transform(
                        elements_at(x, "$.departments"),
                        lambda d, k: _row("department", _join(i, j, k), text_at(d, "$.name")),
                    ),
                )
            ),
        )
    )


def _locations(work: Column) -> Column:
    return F.transform(elements_at(work, "$.locations"), lambda x, i: _row("location", _join(i), text_at(x, "$.id")))


def _all(work: Column) -> Column:
    """The rows of all four tables, with each list extracted once: authors, their institutions and those' departments in one walk."""

    def of_institution(x: Column, i: Column, j: Column) -> Column:
        below = F.transform(elements_at(x, "$.departments"), lambda d, k: _row("department", _join(i, j, k), text_at(d, "$.name")))
        return F.concat(F.array(_row("institution", _join(i, j), text_at(x, "$.id"))), below)

    def of_author(a: Column, i: Column) -> Column:
        below = F.flatten(F.transform(elements_at(a, "$.institutions"), lambda x, j: of_institution(x, i, j)))
        return F.concat(F.array(_row("author", _join(i), text_at(a, "$.author.display_name"))), below)

    named = F.flatten(F.transform(elements_at(work, "$.authorships"), of_author))
    return F.concat(named, _plain_authors(work), _locations(work))


WALKS: dict[str, Callable[[Column], Column]] = {
    "author": _authors,
    "institution": _institutions,
    "department": _departments,
    "location": _locations,
}


def _emit(records: DataFrame, id_col: str, raw_col: str, rows: Callable[[Column], Column]) -> DataFrame:
    parsed = with_works(records.select(F.col(id_col).alias("record_id"), F.col(raw_col).alias("raw")), "raw", "works")
    arrays = parsed.select(
        "record_id",
        F.array_distinct(
            F.filter(
                F.flatten(F.transform("works", lambda w: rows(w))),
                lambda r: r["item"].isNotNull() & (F.length(F.trim(r["item"])) > 0),
            )
        ).alias("rows"),
    )
    return arrays.select("record_id", F.inline("rows"))


def flatten_records(records: DataFrame, id_col: str = "id", raw_col: str = "raw") -> DataFrame:
    """All child rows of every record: (record_id, child, path, item)."""
    return _emit(records, id_col, raw_col, _all)


def child_table(records: DataFrame, child: str, id_col: str = "id", raw_col: str = "raw") -> DataFrame:
    """One target table: (record_id, path, item) plus ``parent_path`` linking it to its parent's row."""
    if child not in WALKS:
        raise ValueError(f"unknown child table {child!r}; one of {', '.join(CHILDREN)}")
    out = _emit(records, id_col, raw_col, WALKS[child])
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[0-9]+$", ""))
    return out.select("record_id", "path", parent.alias("parent_path"), "item")
