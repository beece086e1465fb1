"""What the operators share: column selection, vectorised batches, text words and byte files on any Spark file system."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.session import BATCH_BYTES, bounded_batches, materialised, shared_dir, shared_path  # noqa: F401

__all__ = ["SPACE", "arrow_batches", "bounded_batches", "join_hot", "materialised", "merged", "per_batch", "read_binary_files", "release", "remove", "shared_dir", "shared_path", "table", "write_binary_files"]

#: ASCII white space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = " \t\n\x0b\x0c\r"


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that spans cover, ascending."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


#: A key with more rows than this, or than a hundred-thousandth of all, is hot: such keys are at most 100,000, so their table is broadcast.
HOT = 10_000


def join_hot(rows: DataFrame, by_key: DataFrame, key: str) -> DataFrame:
    """rows joined with by_key, which has one row a key and n, the number of rows with it; n is left out of the result.

    Rows of hot keys stay where they are and meet a broadcast of the few hot ones; only the others are shuffled.
    """
    size = by_key.agg(F.sum("n").alias("total"), F.max("n").alias("largest")).first()
    most = max(HOT, (size.total or 0) // 100_000)
    if (size.largest or 0) <= most:
        return rows.join(by_key.drop("n"), key)
    hot, cold = by_key.where(F.col("n") > most).drop("n"), by_key.where(F.col("n") <= most).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def per_batch(df: DataFrame, schema: str, f: Callable[[pa.RecordBatch], dict | None], rows: int | None = None) -> DataFrame:
    """df.mapInArrow with f from a record batch to columns by name; rows bounds what f gets at once."""
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(fields)
        for batch in batches:
            for at in range(0, batch.num_rows, rows or max(batch.num_rows, 1)):
                part = batch.slice(at, rows) if rows else batch
                made = f(part)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(made[x.name], type=x.type) for x in out], schema=out)

    return df.mapInArrow(run, fields)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows between the JVM and Python for what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_binary_files(df: DataFrame, column: str, path: str, by: str | None = None) -> None:
    """Writes each row's bytes as one file below path (in folders by=value), through Spark's own committed text writer.

    So it works on every file system that Spark can write, and a lost or speculative task leaves no partial file. The text
    writer ends each record with a line separator, so every value must end in the byte 0x00, which becomes that separator:
    the files hold exactly the given bytes. Formats that can end otherwise append a valid padding (see warc, simple8b).
    """
    body = F.expr(f"cast(substring({column}, 1, length({column}) - 1) as string)")
    writer = df.select(body.alias("value"), *([by] if by else [])).write.option("maxRecordsPerFile", 1)
    (writer.partitionBy(by) if by else writer).option("lineSep", "\u0000").option("compression", "none").text(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of ours on any file system."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def release(df: DataFrame) -> None:
    """Deletes the files of a materialised() table that nothing reads any more."""
    if path := getattr(df, "materialised_at", None):
        remove(df.sparkSession, path)


def read_binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the files that write_binary_files made. File splits hold one whole file each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
