"""Session helpers shared by every operator: tables, durable cuts of lineage, task counts."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_session(app: str = "paperloom", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only where none is named."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = Path(tempfile.mkdtemp(prefix="paperloom-cp-")).as_uri()
    sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the checkpoint folder and read from there.

    It cuts the lineage, survives lost executors and, unlike ``checkpoint()``, computes
    the rows only once. ``release`` removes the table.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._paperloom_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Remove a table made by ``durable`` that nothing will read again."""
    path = getattr(df, "_paperloom_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def task_target(spark: SparkSession, per_core: int = 2) -> int:
    """How many tasks keep every core busy, and never fewer than the shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * per_core)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Round-robin only when the scan has too few splits to feed the cores."""
    want = task_target(df.sparkSession, per_core)
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
