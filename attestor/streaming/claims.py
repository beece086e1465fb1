"""Claim streams: the same verdicts on streaming DataFrames, windowed counts, and a watch for files that stop growing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.session import shared_path


def windowed(verdicts: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of verdicts (ts, status) per tumbling window; on a stream with a watermark, so that state is dropped."""
    kind = verdicts.schema["ts"].dataType
    counted = _marked(verdicts, late).groupBy(F.window("ts", every).alias("w"), "status").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").cast(kind).alias("start"), "status", "n")


def _marked(rows: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark, for which its time must have the session's zone; other rows as they are."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if rows.isStreaming else rows


def once(verdicts: DataFrame, key: str = "claim_id", late: str = "10 minutes") -> DataFrame:
    """Without repeated claims; on a stream within the watermark."""
    return _marked(verdicts, late).dropDuplicatesWithinWatermark([key]) if verdicts.isStreaming else verdicts.dropDuplicates([key])


def staged(rows: DataFrame, path: str, by: str, batches: int) -> None:
    """Rows as Parquet files below path that a stream reads in order of by, about so many batches."""
    rows.repartitionByRange(batches, by).write.parquet(path)


def finished(streaming: DataFrame, path: str, keys: list[str], mode: str = "update") -> DataFrame:
    """What a stream amounts to when its source is exhausted: rows are written batch by batch, with the batch's
    number, and for each key the last one counts. The checkpoint lies beside them, so a restart goes on where it stopped."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    running = streaming.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_path(streaming.sparkSession, "progress")).trigger(availableNow=True).start()
    running.awaitTermination()
    rows = streaming.sparkSession.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "batch")


def wait_until_stable(count: Callable[[], int], poll: float = 1.0, stable: float = 5.0, most: float = 60.0, sleep=time.sleep, now=time.monotonic) -> tuple[int, bool]:
    """The count and whether it has stayed the same for the stable time within the most time."""
    began = since = now()
    last = count()
    while now() - began < most:
        if now() - since >= stable:
            return last, True
        sleep(poll)
        if (fresh := count()) != last:
            last, since = fresh, now()
    return last, False
