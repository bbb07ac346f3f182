"""Written intermediate tables, in the folder that all executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemill-checkpoints-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset on one machine, as in tests, a folder of this process; unset on a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or _own_folder()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor costs no rework."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes tables that materialize() wrote; for tables that no returned frame reads."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(documents: DataFrame, wanted: str) -> str:
    """The wanted column name, with underscores before it until no column of documents has it."""
    taken = {c.lower() for c in documents.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_row_numbers(documents: DataFrame) -> tuple[DataFrame, str]:
    """(documents with a row number, the number's column name), written once: every later reading sees the same numbers."""
    name = free_name(documents, "_row")
    return materialize(documents.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def join_hot(rows: DataFrame, groups: DataFrame, key: str, by: str, most: int = 512, few: int = 500_000) -> DataFrame:
    """rows joined with groups, a written table of a row per key and the key's number of rows in `size`.

    The rows of a key of more than `most` are dealt to several tasks by a hash of `by`, and its group goes to all of
    them. Which keys are hot is broadcast, `few` at most; with more of them Spark's own handling of skew is left to it.
    """
    parts = F.ceil(F.col("size") / most).cast("int")
    hot = groups.filter(F.col("size") > most).select(key, parts.alias("_parts"))
    if not 0 < hot.limit(few + 1).count() <= few:
        return rows.join(groups, key)
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    spread = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(spread, [key, "_part"]).drop("_part")
