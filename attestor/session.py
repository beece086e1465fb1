"""Spark session and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", app: str = "attestor") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the one spark-submit gives."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    importable(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where they see the driver's files; elsewhere spark-submit --py-files ships it."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root


#: Bytes from which a scan is worth dealing out.
SPREAD_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores, as of one file with one row group, dealt out to all; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size >= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


#: Most bytes of a batch between the JVM and Python, but for a longer row: either side holds whole batches for each task of an executor.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches between the JVM and Python have at most BATCH_BYTES, or less if the session says so.

    This stays set, as what is returned to a caller runs later; it changes how many rows go at once, not which.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark runs in this process."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if there:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(there)
        return there.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = Path("/tmp/checkpoints")
    base.mkdir(parents=True, exist_ok=True)
    own = "file://" + tempfile.mkdtemp(dir=base)
    sc.setCheckpointDir(own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there and every executor sees it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialised_at = path
    return out
