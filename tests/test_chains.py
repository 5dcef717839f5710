"""The queries on groups where links run in a chain whose ids rise and fall: plain label propagation stopped there with 'no fixpoint'."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import connect, difference

QUERIES = [
    "group_verdict",
    "screening_collapse",
    "unwind_candidates",
    "components",
    "group_sizes",
    "merge_roundtrip",
    "merged_fields",
    "survivor",
    "group_strategy",
    "merge_screening_conflicts",
    "record_repoint",
]


@pytest.fixture(scope="module")
def chained(spark, sf_dir, tmp_path_factory):
    """The small tables, and 400 records beyond them linked one by one in no order, the last to a paper."""
    out = tmp_path_factory.mktemp("chained")
    for table in Path(sf_dir).iterdir():
        if table.name != "pairs.parquet":
            (out / table.name).symlink_to(table)
    ids = list(range(1000, 1400))
    random.Random(5).shuffle(ids)
    links = spark.createDataFrame([(a, b, 0.95, "title_trgm") for a, b in zip(ids, [*ids[1:], 1])], "a long, b long, similarity double, strategy string")
    spark.read.parquet(f"{sf_dir}/pairs.parquet").unionByName(links).write.parquet(f"{out}/pairs.parquet")
    return str(out)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql_on_a_chain_in_no_order(spark, chained, name):
    assert difference(spark, connect(chained), entry.queries()[name], entry.oracle_sql()[name], chained) is None


def test_merge_snapshot_on_a_chain_in_no_order(spark, chained):
    """It has no SQL: the members of every group that is not flagged, as far as they are papers."""
    con, sql = connect(chained), entry.oracle_sql()
    flagged = {root for root, _, _, verdict in con.execute(sql["group_verdict"]).fetchall() if verdict == "flagged"}
    held, want = {i for (i,) in con.execute("SELECT id FROM papers").fetchall()}, {}
    for i, root in con.execute(sql["components"]).fetchall():
        if root not in flagged and i in held:
            want.setdefault(root, []).append(i)
    rows = entry.queries()["merge_snapshot"](spark, chained).collect()
    assert sorted(r.members for r in rows) == sorted(",".join(map(str, sorted(m))) for m in want.values())
    assert all(str(r.kept_paper_id) in r.members.split(",") and r.deleted == r.members.count(",") for r in rows) and flagged


def test_merge_snapshot_rows_on_a_chain_in_no_order(spark, chained):
    """Survivor, number deleted and members of every row equal those of the SQL of the other queries."""
    con, sql = connect(chained), entry.oracle_sql()
    for name in ("components", "group_verdict", "survivor"):
        con.execute(f"CREATE TABLE q_{name} AS {sql[name]}")
    want = con.execute("""
        SELECT survivor, count(*) - 1, string_agg(m.id::varchar, ',' ORDER BY m.id) FROM q_components m JOIN q_survivor USING (root) JOIN papers p ON p.id = m.id
        WHERE root NOT IN (SELECT root FROM q_group_verdict WHERE verdict = 'flagged') GROUP BY survivor""").fetchall()
    rows = entry.queries()["merge_snapshot"](spark, chained).collect()
    assert sorted((r.kept_paper_id, r.deleted, r.members) for r in rows) == sorted(want) and want
