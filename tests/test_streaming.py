from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from paperloom.streaming.ingest import first_of_key, intake_by_window, record_stream, upsert_records

SCHEMA = "id long, source string, source_id string, raw string, fetched_at timestamp, paper_id long, query_name string"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def row(i, key, raw, day, query=None):
    return (i, "s", key, raw, dt.datetime(2024, 1, day), None, query)


def test_upsert_is_idempotent(spark, tmp_path):
    src, table, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    write(spark, src, [row(1, "x", "old", 1, "q1"), row(2, "y", "only", 1)])
    stream = record_stream(spark, str(src), spark.read.parquet(str(src)).schema)
    upsert_records(stream, str(table), str(cp)).awaitTermination(60)
    write(spark, src, [row(3, "x", "new", 2, "q2")])
    upsert_records(stream, str(table), str(cp)).awaitTermination(60)
    got = lambda: {(r.source_id, r.raw, r.query_name) for r in spark.read.parquet(str(table)).collect()}
    assert got() == {("x", "new", "q1"), ("y", "only", None)}
    upsert_records(stream, str(table), str(tmp_path / "fresh")).awaitTermination(60)  # everything once more
    assert got() == {("x", "new", "q1"), ("y", "only", None)}


def test_windows_and_first_of_key(spark, tmp_path):
    src = tmp_path / "in"
    write(spark, src, [row(1, "x", "a", 1, "k"), row(2, "y", "b", 1, "k"), row(3, "z", "c", 5)])
    schema = spark.read.parquet(str(src)).schema
    q = intake_by_window(record_stream(spark, str(src), schema)).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select n from w").collect()) == [1, 2]
    q = first_of_key(record_stream(spark, str(src), schema), "query_name", "fetched_at").writeStream.format("memory").queryName("f").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from f").select(F.col("query_name")).collect() == [("k",)]
