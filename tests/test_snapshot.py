"""A merge's snapshot holds all that undoing it needs: fields, records and screenings as they were, not only counts and ids."""

from __future__ import annotations

import datetime as dt

import __spark_entry__ as entry
from paperloom.operators import groups
from tests.oracle_compare import connect


def test_whole_snapshot_equals_sql(spark, sf_dir):
    con, sql = connect(sf_dir), entry.oracle_sql()
    rows = {r.kept_paper_id: r for r in entry.queries()["merge_snapshot"](spark, sf_dir).collect()}
    for name in ("group_strategy", "survivor", "merge_screening_conflicts"):
        con.execute(f"CREATE TABLE q_{name} AS {sql[name]}")
    ids = {k: [r.survivor_before.id, *(p.id for p in r.deleted_papers)] for k, r in rows.items()}
    assert all(sorted(i) == sorted(map(int, rows[k].members.split(","))) and i[0] == k for k, i in ids.items())
    fields = ", ".join(groups.FIELDS)
    for k, r in rows.items():
        own = f"IN ({rows[k].members})"
        want = {p[0]: p for p in con.execute(f"SELECT id, {fields} FROM papers WHERE id {own}").fetchall()}
        assert {p.id: tuple(p) for p in (r.survivor_before, *r.deleted_papers)} == want
        assert [tuple(x) for x in r.source_record_map] == con.execute(f"SELECT id, paper_id FROM source_records WHERE paper_id {own} ORDER BY id").fetchall()
        said = con.execute(f"SELECT collection_id, paper_id, user_id, decision, note, decided_at FROM screenings WHERE paper_id {own}").fetchall()
        assert sorted(map(repr, map(tuple, r.screening_map))) == sorted(map(repr, said))
    want = con.execute("SELECT survivor, strategy, sim, coalesce((SELECT list(DISTINCT collection_id ORDER BY collection_id) FROM q_merge_screening_conflicts c WHERE c.root = s.root), []) FROM q_survivor s JOIN q_group_strategy USING (root)").fetchall()
    assert {(k, r.strategy, round(r.similarity, 6), *r.conflicts) for k, r in rows.items()} == {(k, s, x, *c) for k, s, x, c in want if k in rows}
    assert any(r.source_record_map for r in rows.values()) and any(r.screening_map for r in rows.values())


def test_withdrawn_rows_strays_and_earlier_merges(spark):
    fields = ", ".join(f"CAST(NULL AS {'array<string>' if f == 'authors' else 'string'}) AS {f}" for f in groups.FIELDS)
    p = spark.sql(f"SELECT id, {fields} FROM VALUES (1L), (2L), (3L) AS t(id)")
    m = spark.createDataFrame([(1, 1), (2, 1), (9, 1)], "id long, root long")  # 9 is no paper
    c = spark.createDataFrame([(1, 2)], "root long, survivor long")
    r = spark.createDataFrame([(11, 1), (12, 2), (13, 3), (19, 9), (20, None)], "id long, paper_id long")
    t = dt.datetime(2024, 1, 1)
    said = [(5, 1, 7, None, "taken back", t), (5, 1, 7, "include", None, t), (5, 3, 7, "include", None, t)]
    s = spark.createDataFrame(said, "collection_id long, paper_id long, user_id long, decision string, note string, decided_at timestamp")
    old = spark.createDataFrame([(100, 1), (101, 2), (102, 3)], "id long, kept_paper_id long")
    row = groups.merge_snapshot(p, m, c, r, s, old).first()
    assert (row.kept_paper_id, row.survivor_before.id, [x.id for x in row.deleted_papers]) == (2, 2, [1])
    assert [tuple(x) for x in row.source_record_map] == [(11, 1), (12, 2)] and {tuple(x) for x in row.screening_map} == set(said[:2]) and len(row.screening_map) == 2
    assert [tuple(x) for x in row.prior_merge_map] == [(100, 1)]
    assert groups.merge_snapshot(p, m, c, r.where("false"), s.where("false"), old.where("false")).first()[-3:] == ([], [], [])
