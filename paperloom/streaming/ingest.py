"""Structured Streaming: records kept current, windowed intake, jobs taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.session import durable, release
from paperloom.sources.records import latest_records


def record_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 10) -> DataFrame:
    """Record files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_records(stream: DataFrame, table: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Fold each batch into a table in buckets of keys: latest row per record, first known query.

    A batch reads and rewrites only the buckets it touches. Folding a row in again changes nothing, so a replayed
    batch or a fresh checkpoint over an old table does no harm.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("source", "source_id"), F.lit(buckets)).cast("int")
        new = batch.withColumn("bucket", bucket)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            held = spark.read.parquet(table).where(F.col("bucket").isin(touched)).drop("fetches")
            new = held.unionByName(new, allowMissingColumns=True)
        merged = durable(latest_records(new).withColumn("bucket", bucket))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
        release(merged)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def intake_by_window(stream: DataFrame, time: str = "fetched_at", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per window and source; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "source").agg(F.count(F.lit(1)).alias("n"))


def first_of_key(stream: DataFrame, key: str, time: str, within: str = "1 day") -> DataFrame:
    """Each non-null key once within the watermark; null keys never collide."""
    keyed = stream.where(F.col(key).isNotNull()).withWatermark(time, within).dropDuplicatesWithinWatermark([key])
    return keyed
