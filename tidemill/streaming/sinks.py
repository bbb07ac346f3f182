"""Sinks of event streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_events(path: str, publish: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that stores a batch under its number, so that a batch that runs again replaces itself, and
    publishes it only once it is stored. A subscriber that fails is dropped; the stream goes on.
    """
    alive = [publish] if publish else []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        for subscriber in list(alive):
            try:
                subscriber(batch)
            except Exception:  # noqa: BLE001  whatever the subscriber's trouble is
                alive.remove(subscriber)

    return write


def last_writes(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key by the order columns; changes that tie there are told apart by their other columns.

    Changes combine in each task before they are shuffled, so that a key with very many of them costs one row a task.
    """
    rest = [c for c in changes.columns if c not in keys and c not in order]
    last = changes.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(*(F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in changes.columns))


@dataclass
class UpsertLog:
    """A table that a stream writes by key: each batch leaves its last writes under its number, readers take the last write of all.

    A batch costs its own size, whatever the table's. One that runs again replaces what it wrote, and one that fails leaves nothing
    that readers see. compact() folds all batches so far into a base; a batch that the base holds has no effect if it runs again.
    """

    path: str
    keys: list[str]
    order: list[str]

    def write(self, batch: DataFrame, number: int) -> None:
        last_writes(batch, self.keys, self.order).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the finished parts of a kind."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}=*/_SUCCESS")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found or [])

    def current(self, spark: SparkSession) -> DataFrame:
        """The last write of each key. Of equal order values the later batch wins."""
        bases = self._numbers(spark, "base")[-1:]
        parts = [f"{self.path}/base={n}" for n in bases] + [f"{self.path}/batch={n}" for n in self._numbers(spark, "batch") if not bases or n > bases[0]]
        if not parts:
            raise FileNotFoundError(f"nothing was written to {self.path} yet")
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:base|batch)=(-?\d+)/", 1).cast("long")
        rows = spark.read.parquet(*parts)
        return last_writes(rows.withColumn("_number", number), self.keys, [*self.order, "_number"]).drop("_number")

    def compact(self, spark: SparkSession) -> None:
        """Folds the batches so far into a new base."""
        numbers = self._numbers(spark, "batch")
        if numbers and numbers[-1:] != self._numbers(spark, "base")[-1:]:
            self.current(spark).write.mode("overwrite").parquet(f"{self.path}/base={numbers[-1]}")


def replay_then_follow(log: DataFrame, live: DataFrame, after: int, write: Callable[[DataFrame, int], None], delay: str = "10 minutes", key: str = "event_id", session: str = "session_id", order: str = "sequence_num", time: str = "created_at") -> DataFrame:
    """Writes what the log holds after an offset as batch -1 and gives what is to be followed of a live stream, which may overlap it.

    Live events up to the last one replayed of their session are known already; that is one number a session, no state.
    Events that the stream itself delivers again within `delay` are dropped by their key; state older than that is given up.
    The live stream must have begun before the log is read, so that no event falls between the two.
    """
    replayed = log.filter(F.col(order) > after)
    write(replayed, -1)
    known = replayed.groupBy(session).agg(F.max(order).alias("_known"))
    new = live.join(known, session, "left").filter(F.col(order) > F.coalesce("_known", F.lit(after))).drop("_known")
    return new.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]).select(*log.columns)


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The current rows with the last change of each key in place; keys that are new are added."""
    w = Window.partitionBy(key).orderBy(F.col("_new").desc(), F.col(order).desc())
    every = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return every.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank", "_new")


def duplicate_sequences(events: DataFrame) -> DataFrame:
    """(session_id, sequence_num) that several events have: there must be none."""
    return events.groupBy("session_id", "sequence_num").agg(F.count("*").alias("n")).filter("n > 1")
