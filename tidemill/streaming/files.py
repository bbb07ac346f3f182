"""Streams over tables and tables out of streams, in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemill-streams-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in spark.checkpoint.dir; where that is unset, on one machine, in a folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or _own_folder()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_stream(df: DataFrame, order: str, batches: int = 3, rows_a_file: int = 250_000) -> DataFrame:
    """A stream of the rows of a table in as many batches, each a range of the numbers in `order`.

    The table is worked out once, by all tasks. Every batch is the same number of files, over which its rows are spread by a hash of
    their numbers, as a range of them may lie in few files of the table; a batch that needs fewer has empty ones, so that a trigger
    takes one batch exactly.
    """
    spark, path, whole = df.sparkSession, new_folder(df.sparkSession, "arrivals"), new_folder(df.sparkSession, "whole")
    df.write.parquet(whole)
    rows = spark.read.schema(df.schema).parquet(whole)
    low, high, n = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    if low is None:
        df.limit(0).write.parquet(f"{path}/0")
    files = max(1, -(-n // (batches * rows_a_file)))
    for k in range(batches if low is not None else 0):
        lo, hi = (low + (high + 1 - low) * x // batches for x in (k, k + 1))
        rows.filter((F.col(order) >= lo) & (F.col(order) < hi)).repartition(files, order).write.parquet(f"{path}/{k}")
        for _ in range(files - len(spark.read.schema(df.schema).parquet(f"{path}/{k}").inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


def run_through(stream: DataFrame, write: Callable[[DataFrame, int], None], name: str, mode: str = "append") -> None:
    """Runs a stream over all that has arrived, batch by batch, and waits for it."""
    folder = new_folder(stream.sparkSession, f"{name}-progress")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
